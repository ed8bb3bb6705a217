"""Audit of how text filters interact in every order of application.

A document fails a set of filters, its *mask*; which filter of an order removes it depends on the mask alone.

1. Each text is read once and gives four failures; the fifth (a copy of a smaller id's text) comes from the smallest id
   of every text key. Documents are counted by (part, mask): at most 32 rows a part, added up before every shuffle.
2. The 120 orders are numbered by their Lehmer rank, that is in lexicographic order. The orders in which a mask is
   removed at step s by filter f start with s - 1 letters outside the mask, then f: those of one such start are
   neighbours, (5 - s)! of them. Each mask adds its counts at both ends of each of its intervals in a difference array
   by (step, rank), and a prefix sum over the ranks gives what every order removes at every step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import materialize, text_of

LETTERS = "ABCDE"
SPACES = "[\\x20\\x09-\\x0D]+"
MARKS = "[#$%&*|]"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # per cent of the words
MOST_CAPITALS = 5  # per cent of the code points
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text: few words, repeated words, capital letters, marks."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [n < LEAST_WORDS, F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
            capitals * 100 > F.length(text) * MOST_CAPITALS, text.rlike(MARKS)]


def removal_intervals(mask: int, letters: int = len(LETTERS)) -> Iterator[tuple[int, int, int]]:
    """(step from 0, first rank, end rank) of every run of orders that remove ``mask`` (bit k: filter k) at that step.

    A start of an order has the rank sum of d_i * (n - 1 - i)!, d_i being the unused letters before letter i."""

    def walk(step: int, rank: int, used: int) -> Iterator[tuple[int, int, int]]:
        width = factorial(letters - 1 - step)
        unused = [f for f in range(letters) if not used >> f & 1]
        for digit, f in enumerate(unused):
            if mask >> f & 1:
                yield step, rank + digit * width, rank + (digit + 1) * width
            else:
                yield from walk(step + 1, rank + digit * width, used | 1 << f)

    if mask:
        yield from walk(0, 0, 0)


def audit_counts(masks: np.ndarray, counts: np.ndarray, letters: int = len(LETTERS)) -> dict[str, np.ndarray]:
    """The counts of one part for each rank and step (arrays of ranks x steps), from the rows of ``counts`` (all, good,
    toxic) of each mask."""
    ranks = factorial(letters)
    ends = np.zeros((3, letters, ranks + 1), dtype=np.int64)
    failing, alone = np.zeros(letters, dtype=np.int64), np.zeros(letters, dtype=np.int64)
    for mask, row in zip(masks.tolist(), counts, strict=True):
        for step, first, end in removal_intervals(mask, letters):
            ends[:, step, first] += row
            ends[:, step, end] -= row
        for f in range(letters):
            failing[f] += row[0] if mask >> f & 1 else 0
            alone[f] += row[0] if mask == 1 << f else 0
    removed, good, toxic = ends.cumsum(axis=2)[:, :, :ranks].transpose(0, 2, 1)
    order = np.array(list(permutations(range(letters))))  # lexicographic, as the ranks
    shapley = np.array([removed[order == f].sum() for f in range(letters)])
    return {"kept": counts[:, 0].sum() - removed.cumsum(axis=1), "removed": removed,
            "redundant": failing[order] - removed, "unique_fails": alone[order],
            "good_lost": good, "toxic_lost": toxic, "shapley": shapley[order]}


def _audit_part(table: pa.Table) -> pa.Table:
    counts = np.stack([table[c].to_numpy() for c in ("n", "good", "toxic")], axis=1)
    found = audit_counts(table["mask"].to_numpy(), counts)
    names = ["".join(p) for p in permutations(LETTERS)]
    rows = len(names) * len(LETTERS)
    return pa.table({
        "part": pa.array([table["part"][0].as_py()] * rows, pa.string()),
        "filter_order": pa.array(np.repeat(names, len(LETTERS)).tolist(), pa.string()),
        "step": pa.array(np.tile(np.arange(1, len(LETTERS) + 1), len(names)), pa.int32()),
        **{c: pa.array(found[c].reshape(-1), pa.int64()) for c in COUNTS},
    })


def filter_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source", label_cols: Sequence[str] = ("quality", "toxic")) -> DataFrame:
    """``part``, ``mask`` (bits 0 to 4: filters A to E) and how many documents have them: ``n``, ``good``, ``toxic``."""
    text = text_of(text_col)
    failures = text_failures(F.col("text"))
    bits = sum((c.cast("int") * (1 << k) for k, c in enumerate(failures)), F.lit(0))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    # 256 bits stand for the text; equal rows become one here, so no key below has unboundedly many rows
    rows = read.select("id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("key"), bits.alias("bits"))
    rows = rows.groupBy("id", "part", "key", "bits").agg(F.count(F.lit(1)).alias("n"))
    good, toxic = (F.max((F.col(c) == 1).cast("int")) for c in label_cols)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(good, F.lit(0)).alias("good"), F.coalesce(toxic, F.lit(0)).alias("toxic"))
    known = rows.where("id is not null").join(marks, "id", "left").select(
        "id", "part", "key", "bits", "n", *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")))
    nameless = rows.where("id is null").select("*", F.lit(0).cast("bigint").alias("good"),
                                               F.lit(0).cast("bigint").alias("toxic"))
    counted = materialize(known.unionByName(nameless), "audit_rows")

    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    # the copies are all documents but those that have their text's smallest id, and those without any id
    first = counted.where("id is not null").groupBy("key").agg(F.min("id").alias("id"))
    heads = counted.join(first, ["key", "id"], "left_semi").unionByName(
        counted.where("id is null").select("key", "id", "part", "bits", "n", "good", "toxic"))
    copy = 1 << LETTERS.index("E")
    whole = counted.groupBy("part", "bits").agg(*sums).withColumn("mask", F.col("bits") + copy)
    heads = heads.groupBy("part", "bits").agg(*sums)
    less = heads.select("part", (F.col("bits") + copy).alias("mask"), *(-F.col(c) for c in ("n", "good", "toxic")))
    own = heads.select("part", F.col("bits").alias("mask"), "n", "good", "toxic")
    return whole.select("part", "mask", "n", "good", "toxic").union(less).union(own).groupBy("part", "mask").agg(*sums)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source", label_cols: Sequence[str] = ("quality", "toxic")) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost``, ``shapley``, for each part, each of the 120 orders of the filters and each step.

    Filters (a document fails if): A it has under 50 words, B under 65 % of its words are distinct, C over 5 % of its
    code points are A to Z, D it holds a mark of ``#$%&*|``, E a smaller id has the same text, anywhere in the table.
    Null and empty texts fail A only, and E if a smaller id has one too. Null and empty parts are one part. Rows with
    the same id are different documents, and none of them a copy of the other. A row without an id is no copy, has none
    and has no labels. A document counts as good or toxic if any label row of its id says 1. An empty table gives an
    empty result. Other columns are not read.
    """
    masks = filter_masks(docs, labels, id_col, text_col, part_col, label_cols)
    schema = ", ".join(["part string, filter_order string, step int", *(f"{c} bigint" for c in COUNTS)])
    return masks.groupBy("part").applyInArrow(_audit_part, schema)
