"""Quality classification by importance resampling.

Two generative models of hashed word n-grams (single tokens and pairs) are compared: one of the texts labelled good
(the target; a bounded sample), one of all texts (raw; counted over every document). A document's importance weight is
the ratio of its probabilities under the two. ``k`` documents are drawn without replacement in proportion to the
weights by the Gumbel top-k rule: the k largest of log weight + Gumbel noise, the noise keyed by seed and id.

``k`` is the number of documents whose weight passes the cut that parts the labelled sample best, so it follows the
corpus. The k-th largest key is found by counting keys in ever narrower ranges; no task sorts or holds all keys.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import carried, held_by_worker, labelled_sample, materialize, text_of, uncarried, utf8, word_cache

BUCKETS = 1 << 13
SAMPLE_ROWS = 2000  # texts of each label to fit on, about
KEY_UNITS = 1 << 20  # keys are whole numbers of 1 / KEY_UNITS
CACHE_WORDS = 250_000  # per Python worker
TOKENS = re.compile(r"\w+|[^\w\s]+")
AGAIN = zlib.crc32(b"\0again")  # stands for a token that repeats the one before it

def _hashes() -> dict:
    return held_by_worker("quality", lambda: word_cache(lambda token: zlib.crc32(utf8(token)), CACHE_WORDS))


def ngram_buckets(text: str) -> np.ndarray:
    """Buckets of the tokens and token pairs of a text, lower case; words and runs of marks are tokens."""
    tokens = TOKENS.findall(text.lower())
    one = np.fromiter(map(_hashes().__getitem__, tokens), np.uint64, len(tokens))
    if len(one) > 1:
        one[1:][one[1:] == one[:-1]] = AGAIN
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    both = np.concatenate([one, two]) * np.uint64(0xD1B54A32D192ED03)
    return (both >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket; the target counts are smoothed with a tenth of raw's."""
    p_raw = (raw + 1) / (raw + 1).sum()
    extra = max(1.0, 0.1 * float(target.sum()))
    p_target = (target + extra * p_raw) / (target.sum() + extra)
    return np.log(p_target / p_raw)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut that parts good from other weights with the least balanced error, in the middle of its gap."""
    if not len(weights) or good.all() or not good.any():
        return -np.inf  # nothing to reject by
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    wrong = np.concatenate([[0.0], np.cumsum(np.where(g, 1 / good.sum(), 0))]) + np.concatenate(
        [np.cumsum(np.where(g, 0, 1 / (~good).sum())[::-1])[::-1], [0.0]])
    edges = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    best = np.flatnonzero(np.isclose(wrong, wrong.min()))
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def kth_largest(rows: DataFrame, col: str, k: int, cells: int = 4096) -> int | None:
    """The k-th largest value of a bigint column, from a few counts over ranges; None if there are fewer than k."""
    ends = rows.agg(F.min(col), F.max(col), F.count(col)).first()
    if k < 1 or ends[2] < k:
        return None
    low, high = ends[0], ends[1]
    while low < high:
        width = -(-(high - low + 1) // cells)
        cell = F.expr(f"({col} - ({low})) div {width}")
        inside = rows.where(F.col(col).between(low, high)).groupBy(cell.cast("bigint").alias("cell")).count().collect()
        above = 0 if high == ends[1] else rows.where(F.col(col) > high).count()
        for at, n in sorted(((r["cell"], r["count"]) for r in inside), reverse=True):
            above += n
            if above >= k:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
    return low


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", *, seed: int = 0, sample_rows: int = SAMPLE_ROWS,
             k: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``log_weight``, ``n_ngrams``, ``key`` (log weight plus noise), ``kept``, and
    the columns ``carry`` (other names than these) as they were.

    ``labels`` has id and label (1: target, 0: not, others: not learned from) of rows of ``docs``. Null and empty texts
    have no n-grams and weight 0 (log). Without a target text all weights are 0; without labels of both kinds every
    document is kept, unless ``k`` says how many to keep. Documents with equal keys (repeated ids and texts) are kept
    or rejected together, so ties can keep more than ``k``. Null ids share their noise. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), carried(carry))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += np.bincount(ngram_buckets(text), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    sample = labelled_sample(docs, labels.where(F.col(label_col).isin(0, 1)), id_col, text_col, label_col, sample_rows)
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for cell in rows.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(
            F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        raw[cell["bucket"]] = cell["n"]
    used = [ngram_buckets(text) for _, text in sample]
    good = np.array([label == 1 for label, _ in sample], dtype=bool)
    for at, yes in zip(used, good, strict=True):
        if yes:
            target += np.bincount(at, minlength=BUCKETS)
    ratio = log_ratio(target, raw) if good.any() else np.zeros(BUCKETS)
    cut = best_cut(np.array([ratio[at].sum() for at in used]), good)
    sent = spark.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        for batch in batches:
            used = [ngram_buckets(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([float(ratio[at].sum()) for at in used], pa.float64()),
                 pa.array([len(at) for at in used], pa.int64()), batch.column("carried")],
                ["id", "log_weight", "n_ngrams", "carried"])

    kind, rest = (rows.schema[c].dataType.simpleString() for c in ("id", "carried"))
    weighed = rows.mapInArrow(weigh, f"id {kind}, log_weight double, n_ngrams bigint, carried {rest}")
    even = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = materialize(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(even))).withColumn(
        "place", F.floor(F.col("key") * KEY_UNITS)), "quality_keys")
    if k is None:
        k = keyed.where(F.col("log_weight") > F.lit(float(cut))).count()
    least = kth_largest(keyed, "place", k)
    # fewer documents than k: all stay; k = 0: none does
    kept = F.lit(k > 0) if least is None else F.col("place") >= F.lit(least)
    return keyed.select(F.col("id").alias(id_col), "log_weight", "n_ngrams", "key", kept.alias("kept"),
                        *uncarried(carry, [id_col]))
