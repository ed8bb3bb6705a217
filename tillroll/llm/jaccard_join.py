"""N-gram Jaccard self-join by chosen paths.

A text's set has its word shingles (five words, lower case). Texts with one set are one record.

1. *Chosen paths.* A record is embedded as the least values of its set under one hash, shingles that very many texts
   have (as a sample of the texts shows) last. It goes to the bucket of each of its ``n - ceil(threshold n) + 1`` least
   values: two sets at the threshold differ in too few shingles to share none of these, so no pair is missed. The sample
   decides on the order only, that is on the size of buckets, never on results.
2. Brute force pairs the records of a bucket, unless their sizes, the places of the shared value in both, or the parity
   of their shingles in some cells show that they differ in too much; each of these bounds holds for every pair at the
   threshold. The records of a bucket over ``LEAF`` are linked to one of them instead of to each other, unproven. The
   links' components hold every pair that can be similar.
3. *Exact check.* Inside each component the whole sets are compared, and the links that span the verified groups give
   the classes. With ``count_links`` blocks of ``PAIR_BLOCK`` records meet by twos, otherwise leaders do.

*Leaders.* A group larger than a block is dealt to blocks, each record to one. A block compares its records with each
other and elects leaders: a record within the threshold of a leader follows it. Only leaders go on, with their radius
(how far their followers are at most), to be dealt again, until they fit one block; so a group of copies costs rows in
proportion to its size. One less the Jaccard similarity obeys the triangle inequality: two records of different leaders
can only be linked if their leaders' distance is at most the linking distance and both radii. The exact check, unless
it finds the two in one class anyway, compares those of their followers that are far enough out to be linked. Leaders
that hardly grow fewer are records that differ: of them alone, all blocks meet.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import carried, held_by_worker, materialize, text_of, uncarried, utf8, word_cache
from tillroll.llm.components import components

WORDS = 5
THRESHOLD = 0.8
PLACES = 64  # of ``min_hashes``
LEAF = 256  # records of a bucket that are paired
CELLS = 512  # parities of a record, at least
SAMPLE = 16  # of so many texts one shows which shingles are frequent
FREQUENT = 3  # times in the sample
MOST_FREQUENT = 1 << 16
BLOCK = 256  # records of a block of leaders; two blocks meet in one task
PAIR_BLOCK = 1024  # records of a block whose links are counted, of up to BLOCK_SHINGLES in all
BLOCK_SHINGLES = 1 << 20
CACHE_WORDS = 250_000  # per Python worker
SEEN = 100_000  # sets of which a task gives the values once

_MIX = np.uint64(0xD1B54A32D192ED03)
_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64)


def _hashes() -> dict:
    return held_by_worker("shingles", lambda: word_cache(
        lambda w: int.from_bytes(hashlib.blake2b(utf8(w), digest_size=8).digest(), "little"), CACHE_WORDS))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text has one, of all its words, and a
    text without words none."""
    tokens = text.lower().split()
    h = np.fromiter(map(_hashes().__getitem__, tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = h[:n].copy()
    for k in range(1, min(words, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return np.unique(_mixed(out + np.uint64(min(words, len(h)))))


def min_hashes(own: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the PLACES hash functions, 32 bits each."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(own), 2048):
        part = (own[a:a + 2048, None] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    return (least & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _taken(n: int, threshold: float) -> int:
    """Least values of a set of n: two sets at the threshold share as many as leaves one among these."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def least_values(own: np.ndarray, frequent: np.ndarray, threshold: float) -> np.ndarray:
    """The first of a set's values, in ascending order but for those in ``frequent`` (sorted), which come last."""
    if len(own) and len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        late = frequent[at] == own
        own = np.concatenate([own[~late], own[late]])
    return own[:_taken(len(own), threshold)]


def parities(own: np.ndarray) -> bytes:
    """Of each of a power of two of cells, one or two for a value, whether an odd number of the set's values fall into
    it: sets differ in as many values as cells at least."""
    cells = max(CELLS, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((_mixed(own) >> np.uint64(20) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def differing(first: bytes, second: bytes) -> int:
    """Cells in which two sets' parities differ, as many cells as the one with fewer has."""
    x, y = (int.from_bytes(b, "little") for b in (first, second))
    bits, least = 8 * max(len(first), len(second)), 8 * min(len(first), len(second))
    while bits > least:  # the parity of two cells together
        bits //= 2
        x, y = (z >> bits ^ z & (1 << bits) - 1 if 8 * len(b) > bits else z for z, b in ((x, first), (y, second)))
    return (x ^ y).bit_count()


def _most_apart(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many values two sets with this sum of sizes may differ in."""
    return (1 - threshold) / (1 + threshold) * sizes + 1e-6


MET_ROWS = "u bigint, v bigint, sure boolean"


def _met(threshold: float, leaf: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (value, rec, at) sorted by value and rec, where ``at`` is the set's size << 32 | place of the value. Gives the
    pairs of each bucket that may be at the threshold, and of a large one a link (sure) to its first record."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 3  # rows of the last bucket, which may go on
        large = None  # its value, once it is over the leaf: then one row is held
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            rows = held if batch is None else [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            value, rec, at = rows
            new = np.ones(len(value), dtype=bool)
            new[1:] = (value[1:] != value[:-1]) | (rec[1:] != rec[:-1])  # copies of a set in several tasks
            value, rec, at = value[new], rec[new], at[new]
            start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            end = np.append(start[1:], len(value))
            bucket = np.repeat(np.arange(len(start)), end - start)
            hot = (end - start > leaf) | (value[start] == large if large is not None else False)
            last = batch is not None and not hot[-1]
            us, vs = [rec[start[bucket]][hot[bucket]]], [rec[hot[bucket]]]
            n_sure = len(us[0])
            cold = np.flatnonzero(~hot[bucket] & (bucket < len(start) - last))
            size, place = at >> 32, at & 0xFFFFFFFF
            for step in range(1, leaf):
                cold = cold[cold + step < end[bucket[cold]]]
                if not len(cold):
                    break
                i, j = cold, cold + step
                near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
                near &= place[i] + place[j] <= _most_apart(size[i] + size[j], threshold)
                us.append(rec[i[near]])
                vs.append(rec[j[near]])
            if batch is not None:
                keep = slice(start[-1], None if last else start[-1] + 1)
                held, large = [value[keep], rec[keep], at[keep]], None if last else value[-1]
            u, v = np.concatenate(us), np.concatenate(vs)
            sure = np.arange(len(u)) < n_sure
            apart = u != v
            yield pa.RecordBatch.from_arrays([pa.array(c[apart]) for c in (u, v, sure)], ["u", "v", "sure"])

    return meet


def _frequent(texts: DataFrame, words: int) -> np.ndarray:
    """Sorted shingles that many texts have, by a sample of the different texts; MOST_FREQUENT at most."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(text, words) for text in batch.column("words").to_pylist()]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["value"])

    sample = texts.where(F.pmod(F.xxhash64("words"), F.lit(SAMPLE)) == 0).select("words").distinct()
    counted = sample.mapInArrow(values, "value bigint").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    found = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "value").limit(MOST_FREQUENT).select("value").collect()
    return np.sort(np.array([r[0] for r in found], dtype=np.int64).view(np.uint64))


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from rows sorted by it; a key's rows may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _span(alike: np.ndarray, union: _Union, first: np.ndarray, second: np.ndarray) -> None:
    """Joins what a boolean matrix over first x second finds alike."""
    for i in np.flatnonzero(alike.any(axis=1)).tolist():
        own = int(first[i])
        for j in second[np.flatnonzero(alike[i])].tolist():
            union.join(own, j)


def _in_blocks(rows: DataFrame, key: str, size: str, round_: int = 0, stuck: Column | None = None, block: int | None = None) -> DataFrame:
    """Rows of (key, rec, size, ...) with ``work``, ``side`` and ``lead``. A group of up to BLOCK (``block``) rows is one
    piece of work; of a larger one every block is a piece that elects leaders or, where ``stuck`` (default: all), every two
    blocks, or one with itself, are one."""
    # powers of two: a record that is in many groups of like size meets the same records there, and their links are one
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col(size) / F.lit(block or BLOCK), F.lit(1.0))))).cast("int")
    stuck = F.lit(True) if stuck is None else stuck
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("rec", F.lit(round_)), blocks.cast("bigint")).cast("int")).withColumn(
        "other", F.explode(F.when(stuck, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("own"))))
    return dealt.withColumn("work", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).withColumn(
        "side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)).withColumn(
        "lead", ~stuck & (blocks > 1)).drop("own", "other")


def _elected(near: np.ndarray) -> np.ndarray:
    """The leader of each record, in order: a record follows the first leader that it is near, or is one itself."""
    leader = np.full(len(near), -1)
    while (leader < 0).any():
        i = int(np.argmax(leader < 0))
        leader[near[i] & (leader < 0)] = i
        leader[i] = i
    return leader


MEMBER, LEADER, UNSURE = 0, 1, 2  # rows that a piece of work gives


def _by_leaders(first: DataFrame, key: str, work_on: Callable, schema: str, columns: Sequence[str], name: str) -> list[DataFrame]:
    """Rounds of leaders over the groups of ``first`` (key, size of the group, rec, radius, ``columns``); ``work_on``
    treats the pieces of work. Returns what each round gave."""
    rounds: list[DataFrame] = []
    sized = first.withColumn("before", F.lit(None).cast("bigint"))
    while True:
        # leaders that are more than half of what was dealt are not copies
        stuck = F.coalesce(F.col("size") * 2 > F.col("before"), F.lit(False)) & (F.col("size") > BLOCK)
        pieces = _in_blocks(sized, key, "size", len(rounds), stuck)
        given = materialize(pieces.select("work", "side", "lead", key, "rec", "radius", "size", *columns).repartition(
            "work").sortWithinPartitions("work").mapInArrow(work_on, schema), name)
        rounds.append(given)
        now = given.where(F.col("kind") == LEADER).select(
            F.col("group").alias(key), F.col("u").alias("rec"), "radius", *columns, F.col("size").alias("before"))
        if now.isEmpty():
            return rounds
        sized = now.join(now.groupBy(key).agg(F.count(F.lit(1)).alias("size")), key)


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


EXACT_ROWS = ("kind int, u bigint, v bigint, leader bigint, distance double, group bigint, size bigint, radius double, "
              "other_radius double, copies bigint, elements binary")


def _exact_leaders(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each piece of work: every record with the one that spans its verified group and, where all records meet,
        its leader; the leaders that go on; or, in a last round, the pairs of leaders whose followers may be linked."""
        for group in _grouped(batches, "work"):
            records, radius, side = group["rec"].to_numpy(), group["radius"].to_numpy(), group["side"].to_numpy()
            blobs = group["elements"].to_pylist()
            lead = bool(group["lead"][0].as_py())
            key, size = group["root"][0].as_py(), group["size"][0].as_py()
            first, second, alike, similarity = _compared(blobs, side, threshold)
            union = _Union(len(records))
            _span(alike, union, first, second)
            own = np.arange(len(records))
            square = not side.any()
            leader = _elected(alike) if square else own
            far = 1 - similarity[own, leader] if square else np.zeros(len(records))
            far[leader == own] = 0
            span = [int(records[union.root(i)]) for i in own.tolist()]
            out = [(MEMBER, int(records[i]), span[i], int(records[leader[i]]), float(far[i]), *[None] * 6) for i in own.tolist()
                   if square or span[i] != records[i]]
            if lead:
                reach = np.zeros(len(records))
                np.maximum.at(reach, leader, far + radius)
                copies = group["copies"].to_numpy()
                out += [(LEADER, int(records[i]), None, None, None, key, size, float(reach[i]), None, int(copies[i]), blobs[i])
                        for i in np.unique(leader).tolist()]
            elif radius.any():
                wide = 1 - threshold + radius[first][:, None] + radius[second][None, :] + 1e-9
                unsure = (1 - similarity <= wide) & ~alike & (radius[first][:, None] + radius[second][None, :] > 0)
                unsure &= (first[:, None] < second[None, :]) if square else np.True_
                for i, j in zip(*np.nonzero(unsure)):
                    a, b = first[i], second[j]
                    if union.root(int(a)) != union.root(int(b)):
                        out.append((UNSURE, int(records[a]), int(records[b]), None, float(1 - similarity[i, j]), key, None,
                                    float(radius[a]), float(radius[b]), None, None))
            if out:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(),
                         pa.float64(), pa.int64(), pa.binary()]
                names = ["kind", "u", "v", "leader", "distance", "group", "size", "radius", "other_radius", "copies", "elements"]
                yield _batch({n: (list(c), t) for n, c, t in zip(names, zip(*out), kinds, strict=True)})

    return check


def _compared(blobs: list[bytes], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first side, second side, linked?, similarity) of the whole sets of a piece of work."""
    sets = [np.frombuffer(b, dtype="<u8") for b in blobs]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    # columns: the elements that several of the sets have
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    kept = often[column] > 1
    row, column = row[kept], (np.cumsum(often > 1) - 1)[column[kept]]
    first, second = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
    shared = np.zeros((len(first), len(second)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at = slice(*np.searchsorted(column, [a, a + width]))
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[row[at], column[at] - a] = 1
        shared += has[first] @ has[second].T
    both = sizes[first][:, None] + sizes[second][None, :]
    alike = shared * (1 + threshold) >= threshold * both - 1e-9
    alike &= first[:, None] != second[None, :]
    return first, second, alike, shared / np.maximum(both - shared, 1)


def _exact_links(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each piece of work: a row for each record with the texts and documents it is linked to here, and the
        record that spans its verified group."""
        for group in _grouped(batches, "work"):
            records, weight = group["rec"].to_numpy(), group["copies"].to_numpy()
            side = group["side"].to_numpy()
            first, second, alike, _ = _compared(group["elements"].to_pylist(), side, threshold)
            union = _Union(len(records))
            _span(alike, union, first, second)
            texts, documents = np.zeros(len(records), dtype=np.int64), np.zeros(len(records), dtype=np.int64)
            texts[first] += alike.sum(axis=1)
            documents[first] += alike @ weight[second]
            if (side != 0).any():  # two blocks: links count on both sides
                texts[second] += alike.sum(axis=0)
                documents[second] += weight[first] @ alike
            linked = np.flatnonzero(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(records[linked]), pa.array([int(records[union.root(i)]) for i in linked.tolist()], pa.int64()),
                 pa.array(texts[linked]), pa.array(documents[linked])], ["u", "v", "texts", "documents"])

    return check


def _between(rounds: list[DataFrame], unsure: DataFrame, threshold: float) -> DataFrame:
    """(work, side, rec): of the unsure pairs of leaders (group: their component) the followers that are far enough out
    to be linked across. A piece of work has all pairs of two parts of a component's leaders."""
    led = None
    for given in rounds:  # the last leader of every record, and a bound of its distance
        step = given.where((F.col("kind") == MEMBER) & F.col("leader").isNotNull()).select(
            F.col("u").alias("at"), F.col("leader").alias("next"), F.col("distance").alias("step")).groupBy("at").agg(
            F.min(F.struct("step", "next")).alias("go"))
        if led is None:
            led = step.select(F.col("at").alias("rec"), F.col("go.next").alias("leader"), F.col("go.step").alias("bound"))
        else:
            led = led.join(step.withColumnRenamed("at", "leader"), "leader", "left").select(
                "rec", F.coalesce("go.next", "leader").alias("leader"), (F.col("bound") + F.coalesce("go.step", F.lit(0.0))).alias("bound"))
    led = materialize(led, "jaccard_led")
    # leaders of a component are put in parts of about half a block of followers; a record is given once to each part
    # that has a leader its own is unsure with, at most as often as its component has parts, however many pairs there are
    both = unsure.select("group", F.col("u").alias("leader")).unionByName(unsure.select("group", F.col("v").alias("leader")))
    parts = led.join(both.distinct(), "leader").groupBy("group").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(BLOCK)).alias("parts"))
    slack = F.col("distance") - (1 - threshold) - 1e-9
    a, b = (F.pmod(F.xxhash64(c), "parts") for c in ("u", "v"))
    placed = unsure.join(parts, "group").select(
        F.xxhash64("group", F.least(a, b), F.greatest(a, b)).alias("pair"), F.when(a <= b, 1).otherwise(2).alias("side"), "u", "v",
        (slack - F.col("other_radius")).alias("u_least"), (slack - F.col("radius")).alias("v_least"))
    ends = placed.select("pair", F.col("u").alias("leader"), "side", F.col("u_least").alias("least")).unionByName(
        placed.select("pair", F.col("v").alias("leader"), (3 - F.col("side")).alias("side"), F.col("v_least").alias("least")))
    ends = ends.groupBy("pair", "side", "leader").agg(F.min("least").alias("least"))
    fringe = led.join(ends, "leader").where("bound >= least").select("pair", "side", "rec")
    sizes = fringe.groupBy("pair").pivot("side", [1, 2]).agg(F.count(F.lit(1)))
    sizes = sizes.select("pair", *(F.ceil(F.col(c) / F.lit(BLOCK)).cast("int").alias(n) for c, n in (("1", "ones"), ("2", "twos")))).where(
        "ones > 0 and twos > 0")
    own = F.when(F.col("side") == 1, F.col("ones")).otherwise(F.col("twos"))
    others = F.when(F.col("side") == 1, F.col("twos")).otherwise(F.col("ones"))
    dealt = fringe.join(sizes, "pair").withColumn("own", F.pmod(F.xxhash64("rec"), own.cast("bigint")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), others - 1)))
    place = F.when(F.col("side") == 1, F.struct("own", "other")).otherwise(F.struct(F.col("other").alias("own"), F.col("own").alias("other")))
    return dealt.select(F.xxhash64("pair", place).alias("work"), "side", "rec")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``node``, ``root`` of components (``groups``, stored) after more links between nodes, also new ones: only the
    groups' roots are linked anew."""
    mapped = links
    for side in ("u", "v"):
        mapped = mapped.join(groups.select(F.col("node").alias(side), F.col("root").alias("to")), side, "left").withColumn(
            side, F.coalesce("to", side)).drop("to")
    moved = materialize(components(mapped), "joined").select(F.col("node").alias("old"), F.col("root").alias("new"))
    old = groups.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return old.unionByName(moved.select(F.col("old").alias("node"), F.col("new").alias("root")).join(groups, "node", "left_anti"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD,
                 words: int = WORDS, carry: Sequence[str] = (), count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id``, ``n_links``, ``n_text_links``, ``class_size``, ``kept``, and the
    columns ``carry`` (other names than these) as they were.

    ``count_links`` compares all records of a component, as every link is counted: the work grows with the square of a
    component's size, the rows with that of its number of blocks. Without it ``representative_id`` and ``similarity`` stand in place of the counts: a document of
    the class that the row is linked to, and the exact Jaccard similarity with it (1 for a set of its own or the same).
    The classes are the same; a group of near copies then costs rows in proportion to its size.

    Two rows are linked if their texts' shingle sets have a Jaccard similarity of ``threshold`` or more. ``n_links``
    counts the other rows a row is linked to, ``n_text_links`` the different sets among them. Classes are the connected
    components of the links; ``class_id`` is the smallest id of a class (null if it has only null ids), and of each
    class one row with that id is ``kept``. Null, empty and
    blank texts have no shingles and no links: each is a class of its own. Rows with the same id are different rows.
    An empty table gives an empty result. Other columns are not read.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"built for a threshold of {THRESHOLD} or more")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("words"),
                       carried(carry))
    kind, rest = (rows.schema[c].dataType.simpleString() for c in ("id", "carried"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, size, high, low, parity = [], [], [], [], []
            for text in batch.column("words").to_pylist():
                own = shingles(text, words)
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                keys.append(key)
                size.append(len(own))
                high.append(int.from_bytes(digest[:8], "little", signed=True) if len(own) else key)
                low.append(int.from_bytes(digest[8:], "little", signed=True) if len(own) else -1)
                parity.append(parities(own) if len(own) else None)
                key += 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "words", "carried")), pa.array(keys, pa.int64()), pa.array(size, pa.int64()), pa.array(high, pa.int64()),
                 pa.array(low, pa.int64()), pa.array(parity, pa.binary())],
                ["id", "words", "carried", "key", "n", "high", "low", "parity"])

    sketched = materialize(rows.mapInArrow(
        sketch, f"id {kind}, words string, carried {rest}, key bigint, n bigint, high bigint, low bigint, parity binary"),
        "jaccard_sketches")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(sketched.where("n > 0"), words))
    # texts with one set are one record: the row with the least key stands for them
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    sets = sketched.groupBy("high", "low").agg(F.min("key").alias("rec"), F.count(F.lit(1)).alias("copies"),
                                                F.min("n").alias("n"), F.min(first).alias("first"))
    sets = materialize(sets, "jaccard_sets")
    marks = sketched.where("n > 0").join(sets.select(F.col("rec").alias("key")), "key", "left_semi").select(
        "high", F.col("key").alias("rec"), "n", "parity")
    marks = materialize(marks, "jaccard_records")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(value, rec, at) of the sets that the task has not seen; a set goes by its digest."""
        seen: set[int] = set()
        for batch in batches:
            values, recs, ats = [], [], []
            for rec, text in zip(batch.column("high").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if rec in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(rec)
                own = shingles(text, words)
                values.append(least_values(own, frequent.value, threshold).view(np.int64))
                recs.append(np.full(len(values[-1]), rec, dtype=np.int64))
                ats.append((len(own) << 32) + np.arange(len(values[-1])))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (values, recs, ats)], ["value", "rec", "at"])

    met = sketched.where("n > 0").select("high", "words").mapInArrow(least, "value bigint, rec bigint, at bigint").repartition(
        "value").sortWithinPartitions("value", "rec").mapInArrow(_met(threshold, LEAF), MET_ROWS)
    met = materialize(met.groupBy("u", "v").agg(F.max("sure").alias("sure")), "jaccard_met")
    for side in ("u", "v"):
        met = met.withColumnRenamed(side, "high").join(marks.select("high", *(
            F.col(c).alias(f"{c}_{side}") for c in ("rec", "n", "parity"))), "high").drop("high")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose parities do not show that they differ in too much."""
        for batch in batches:
            differ = np.fromiter(map(differing, *(batch.column(c).to_pylist() for c in ("parity_u", "parity_v"))), np.int64, batch.num_rows)
            sizes = batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()
            near = (differ <= _most_apart(sizes, threshold)) | batch.column("sure").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[near]) for c in ("rec_u", "rec_v")], ["u", "v"])

    near = materialize(components(materialize(met.mapInArrow(apart, "u bigint, v bigint"), "jaccard_met")), "jaccard_near")

    # whole sets, of the records that have a near one only
    wanted = near.select(F.col("node").alias("key"), "root").join(sets.select(F.col("rec").alias("key"), "copies", "n"), "key")
    if count_links:  # a block is as large as its sets allow
        size = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") * F.lit(PAIR_BLOCK / BLOCK_SHINGLES)))
    else:
        size = F.count(F.lit(1))
    wanted = wanted.drop("n").join(wanted.groupBy("root").agg(size.alias("size")), "root")
    texts = sketched.select("key", "words").join(wanted, "key")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [shingles(text, words).astype("<u8").tobytes() for text in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "root", "copies", "size")),
                                              pa.array(blobs, pa.binary())], ["rec", "root", "copies", "size", "elements"])

    set_rows = "rec bigint, root bigint, copies bigint, size bigint, elements binary"
    whole = texts.mapInArrow(elements, set_rows)
    if count_links:
        compared = _in_blocks(whole, "root", "size", block=PAIR_BLOCK)
        verified = materialize(
            compared.select("work", "side", "rec", "copies", "elements").repartition("work").sortWithinPartitions("work")
            .mapInArrow(_exact_links(threshold), "u bigint, v bigint, texts bigint, documents bigint"), "jaccard_links")
        about = verified.groupBy(F.col("u").alias("rec")).agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
        classes = components(verified.select("u", "v"))
        told = [F.coalesce("texts", F.lit(0)).alias("n_text_links"),
                (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links")]
    else:
        rounds = _by_leaders(whole.withColumn("radius", F.lit(0.0)), "root", _exact_leaders(threshold), EXACT_ROWS,
                             ["copies", "elements"], "jaccard_leaders")
        spans = reduce(DataFrame.unionByName, rounds).where(F.col("kind") == MEMBER).select("u", "v")
        classes = materialize(components(spans), "jaccard_classes")
        unsure = reduce(DataFrame.unionByName, rounds).where(F.col("kind") == UNSURE)
        for side in ("u", "v"):
            unsure = unsure.join(classes.select(F.col("node").alias(side), F.col("root").alias(f"{side}_class")), side)
        unsure = materialize(unsure.where("u_class <> v_class").select(
            "group", "u", "v", "distance", "radius", "other_radius"), "jaccard_unsure")
        if not unsure.isEmpty():
            # stored first, so that its size is known when it is joined to the texts
            more = materialize(_between(rounds, unsure, threshold), "jaccard_fringe").join(sketched.select(F.col("key").alias("rec"), "words"), "rec")
            more = more.select(F.col("rec").alias("key"), F.col("work").alias("root"), F.col("side").cast("bigint").alias("copies"),
                               F.lit(0).cast("bigint").alias("size"), "words").mapInArrow(elements, set_rows)
            sides = more.select(F.col("root").alias("work"), F.col("copies").cast("int").alias("side"), "rec", "elements")
            links = sides.withColumn("copies", F.lit(1).cast("bigint")).repartition("work").sortWithinPartitions("work").mapInArrow(
                _exact_links(threshold), "u bigint, v bigint, texts bigint, documents bigint").where("u <> v").select("u", "v")
            classes = _joined(classes, materialize(links, "jaccard_links"))
        # every record of a component met the others of its block in the first round
        about = rounds[0].where(F.col("kind") == MEMBER).select(F.col("u").alias("rec"), "leader", "distance").join(
            sets.select(F.col("rec").alias("leader"), F.col("first.id").alias("leader_id")), "leader")
        told = [F.when(F.coalesce("leader", "rec") == F.col("rec"), F.col("first.id")).otherwise(F.col("leader_id")).alias("representative_id"),
                F.coalesce(1 - F.col("distance"), F.lit(1.0)).alias("similarity")]

    of_set = sets.join(classes.select(F.col("node").alias("rec"), "root"), "rec", "left").join(
        about, "rec", "left").withColumn("root", F.coalesce("root", "rec"))
    of_class = of_set.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size")).select(
        "root", F.col("first.id").alias("class_id"), F.col("first.key").alias("kept_key"), "class_size")
    known = of_set.select("root", "high", "low", *told).join(of_class, "root")
    mine = sketched.select("id", "high", "low", "key", *(["carried"] if carry else []))
    return mine.join(known, ["high", "low"]).select(
        F.col("id").alias(id_col), "class_id", *(["n_links", "n_text_links"] if count_links else ["representative_id", "similarity"]),
        "class_size",
        (F.col("key") == F.col("kept_key")).alias("kept"),
        *uncarried(carry, [id_col]))
