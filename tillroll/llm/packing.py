"""Best-fit packing of tokenised documents by non-negative least squares over length patterns.

1. Each document becomes token ids and one end id; longer ones are cut into pieces of ``capacity`` ids.
2. The histogram of piece lengths (at most ``capacity`` rows at any input size) comes to the driver. Lengths are
   rounded up to multiples of ``quantum``; every pattern of at most three rounded lengths that fills a sequence
   exactly is a column of a matrix, and non-negative least squares finds how often each pattern should repeat.
3. Pieces are dealt at random into groups of about ``group_pieces``; each group rounds its share of the repeat counts,
   fills the patterns with real pieces and packs the residual pieces best-fit into the space left. A group leaves at
   most a few sequences unfilled, so dealing costs about one sequence in some thousands.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import held_by_worker, materialize, public_file, text_of
from tillroll.llm.token_counts import split_words, stretches

CAPACITY = 4096
QUANTUM = 16
GROUP_PIECES = 8192
END_ID = 1
CACHE_WORDS = 250_000  # per Python worker
LATIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|]*)")

PIECES = "id {id_type}, piece int, start long, length long, ids_crc32 long, row_key long"


class WordIds:
    """Token ids (little-endian unsigned 32-bit bytes) of texts, through a bounded cache of blank-separated words.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in turn. A
    word that holds the string of a special token goes to the tokenizer whole, which takes it out as that token.
    Runs of Latin letters go straight to the tokenizer's merges: its normaliser and splitting pattern leave lower-cased
    ones whole, and its byte alphabet is applied here.
    """

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_buffer(model)
        self.merges = self.full.model
        self.merges._resize_cache(0)  # each run of letters is asked for once
        # bytes with a visible character of their own stand for themselves, the others for characters from 256 on
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        self.alphabet = {b: 256 + k for k, b in enumerate(hidden)}
        self.words: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def _letters(self, word: str) -> bytes:
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        ids = [token.id for token in self.merges.tokenize(raw)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _other(self, word: str) -> bytes:
        ids = self.full.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: list[str]) -> None:
        """Adds the words that the cache lacks; a full cache keeps only those of them that it has. Runs of letters, which
        many words share, are held longer: in two generations, and those used again move to the new one."""
        known, letters, older, others = self.words, self.letters, self.older, self.others
        if len(known) + len(words) > CACHE_WORDS:
            known = self.words = {w: known[w] for w in words if w in known}
            others.clear()
        for w in words:
            if w in known:
                continue
            m = LATIN_WORD.fullmatch(w)
            if m is None:
                known[w] = self._other(w)
                continue
            run, marks = m[1].lower(), m[2]
            ids = letters.get(run)
            if ids is None:
                ids = older.get(run) or self._letters(run)
                if 2 * len(letters) >= CACHE_WORDS:
                    older = self.older = letters
                    letters = self.letters = {}
                letters[run] = ids
            if marks:
                if marks not in others:
                    others[marks] = self._other(marks)
                ids += others[marks]
            known[w] = ids

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order."""
        for part in stretches(texts):
            words, places, bounds = split_words(
                part, lambda t: pc.split_pattern(pc.replace_substring(t, "\n", " "), " "))
            self.learn(words)
            ids = [self.words[w] for w in words]
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            sizes = np.array([len(b) // 4 for b in ids], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                at = places[a:b]
                size = sizes[at]
                before = np.cumsum(size) - size
                yield flat[np.repeat(starts[at] - before, size) + np.arange(size.sum())].tobytes()


def word_ids(model: bytes) -> WordIds:
    """The worker's encoder for this model."""
    return held_by_worker(("packing", zlib.crc32(model)), lambda: WordIds(model))


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, model: bytes) -> DataFrame:
    """One row per piece; ``row_key`` numbers the pieces, equally on each run over the same input."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key = word_ids(sent.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(batch.column("text"))):
                ids += struct.pack("<I", END_ID)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            keys = np.arange(key, key + len(row), dtype=np.int64)
            key += len(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array(keys)],
                ["id", "piece", "start", "length", "ids_crc32", "row_key"])

    return rows.mapInArrow(cut, PIECES.format(id_type=id_type))


def length_patterns(units: int) -> list[tuple[int, ...]]:
    """Every multiset of one, two or three positive lengths with the sum ``units``."""
    out: list[tuple[int, ...]] = [(units,)]
    out += [(a, units - a) for a in range(1, units // 2 + 1)]
    out += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method; ``a`` has a row for each length."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    floor = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        new = int(gradient.argmax())
        if gradient[new] <= floor:
            break
        active[new] = True
        while True:
            at = np.flatnonzero(active)
            part = a[:, at]
            s = np.linalg.lstsq(part.T @ part, part.T @ b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += step * (s - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def fit_patterns(histogram: dict[int, int], capacity: int, quantum: int) -> list[tuple[tuple[int, ...], float]]:
    """(pattern of rounded lengths, repeats per piece), the most frequent first."""
    units = capacity // quantum
    counts = np.zeros(units + 1)
    for length, n in histogram.items():
        counts[-(-length // quantum)] += n
    total = counts.sum()
    present = set(np.flatnonzero(counts))
    patterns = [p for p in length_patterns(units) if present.issuperset(p)]
    if not total or not patterns:
        return []
    a = np.zeros((units + 1, len(patterns)))
    for k, p in enumerate(patterns):
        for unit in p:
            a[unit, k] += 1
    x = nonnegative_least_squares(a, counts / total)
    return sorted(((patterns[k], float(x[k])) for k in np.flatnonzero(x > 0)), key=lambda e: (-e[1], e[0]))


def pack(lengths: np.ndarray, fitted: list[tuple[tuple[int, ...], float]], capacity: int,
         quantum: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one group."""
    order = np.argsort(lengths, kind="stable")
    bins: dict[int, list[int]] = {}
    for i in order.tolist():
        bins.setdefault(-(-int(lengths[i]) // quantum), []).append(i)
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[int] = []
    for pattern, share in fitted:
        need = {unit: pattern.count(unit) for unit in pattern}
        repeats = min([round(share * len(lengths)), *(len(bins.get(u, ())) // k for u, k in need.items())])
        for _ in range(repeats):
            at = 0
            for unit in pattern:
                i = bins[unit].pop()
                sequence[i], offset[i] = len(room), at
                at += int(lengths[i])
            room.append(capacity - at)
    by_room: dict[int, list[int]] = {}
    free = 0  # bit r is set if a sequence has r ids left
    for s, r in enumerate(room):
        by_room.setdefault(r, []).append(s)
        free |= 1 << r
    residual = sorted((i for left in bins.values() for i in left), key=lambda i: (-int(lengths[i]), i))
    for i in residual:
        n = int(lengths[i])
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1  # best fit: the least room that suffices
            s = by_room[r].pop()
            if not by_room[r]:
                free &= ~(1 << r)
        else:
            r, s = capacity, len(room)
            room.append(capacity)
        sequence[i], offset[i] = s, capacity - r
        by_room.setdefault(r - n, []).append(s)
        free |= 1 << (r - n)
    return sequence, offset


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY,
                     quantum: int = QUANTUM, group_pieces: int = GROUP_PIECES,
                     tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null or empty text is its end id alone. Rows with the same id, or none, are packed as separate documents, and
    ids of any type are carried along. Only documents over ``capacity`` ids are cut. An empty table gives an empty
    result. Other columns are not read.
    """
    if capacity % quantum:
        raise ValueError("capacity must be a multiple of quantum")
    pieces = materialize(token_pieces(docs, id_col, text_col, capacity, public_file(tokenizer)), "pack_pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = fit_patterns(histogram, capacity, quantum)
    groups = max(1, -(-sum(histogram.values()) // group_pieces))
    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("row_key"), F.lit(groups)))

    def pack_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row_key")
        sequence, offset = pack(rows["length"].to_numpy(), fitted, capacity, quantum)
        first = (rows["dealt"][0].as_py() << 32) if rows.num_rows else 0
        rows = rows.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
        return rows.drop_columns(["row_key", "dealt"])

    id_type = pieces.schema["id"].dataType.simpleString()
    schema = PIECES.format(id_type=id_type).replace("row_key long", "sequence_id long, `offset` long")
    return dealt.groupBy("dealt").applyInArrow(pack_group, schema).withColumnRenamed("id", id_col)
