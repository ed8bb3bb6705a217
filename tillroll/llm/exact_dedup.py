"""Exact deduplication through an extendible-hash index kept in shared files.

The index is built with DataFrame operations only:

1. One pass counts the bytes of every *slot*, the first ``max_depth`` bits of a 64-bit key of the normalised text
   (at most 2^16 rows reach the driver, whatever the input).
2. The directory starts with one bucket. Whenever a bucket is overfull, it splits on its next key bit, and the
   directory doubles if the bucket's depth was the directory's. A bucket that is still overfull at the last depth
   (many copies of one text share one key, which no split parts) gets *overflow pages*; a row's page comes from its id.
3. Rows go to the task that owns their bucket's key range and page. It sorts them by key and text, so rows whose keys
   collide but whose bytes differ become separate links of the key's chain, and writes the page to the shared folder
   (``spark.checkpoint.dir``). Texts are kept there only for the first row of a chain link of a paged bucket.
4. Pages of one bucket meet again through those first rows only: their texts are compared, and each link's rows take
   the group's id by an equi-join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import materialize, text_of

SPACES = "[\\x20\\x09-\\x0D]+"
KEY_BITS = 64


def normalised(text_col: str) -> Column:
    """Null as empty; each run of blanks, tabs and line ends as one blank."""
    return F.regexp_replace(text_of(text_col), SPACES, " ")


def build_directory(sizes: np.ndarray, max_depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, pages) for each of the 2^max_depth slots, by splitting overfull buckets and doubling the
    directory. ``sizes`` has the bytes of each slot."""
    before = np.concatenate([[0], np.cumsum(sizes)])

    def load(prefix: int, depth: int) -> int:
        width = 1 << (max_depth - depth)
        return int(before[(prefix + 1) * width] - before[prefix * width])

    depth, directory = 0, [(0, 0)]  # an entry is the (prefix, depth) of the bucket it points to
    overfull = [(0, 0)] if max_depth and load(0, 0) > capacity else []
    while overfull:
        prefix, own = overfull.pop()
        if own == depth:  # directory doubling: every entry now stands for two longer prefixes
            directory = [entry for entry in directory for _ in (0, 1)]
            depth += 1
        for half in (2 * prefix, 2 * prefix + 1):
            width = 1 << (depth - own - 1)
            directory[half * width:(half + 1) * width] = [(half, own + 1)] * width
            if load(half, own + 1) > capacity and own + 1 < max_depth:
                overfull.append((half, own + 1))
    out, width = [], 1 << (max_depth - depth)
    for entry, (prefix, own) in enumerate(directory):
        bucket = prefix << (max_depth - own)  # the first slot of its key range
        pages = max(1, -(-load(prefix, own) // capacity)) if own == max_depth else 1
        out += [(slot, bucket, pages) for slot in range(entry * width, (entry + 1) * width)]
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_depth: int = 16,
                least_bucket: int = 1 << 20, most_bucket: int = 64 << 20, key: Column | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if their normalised texts (null: empty) have the same bytes. Of equal texts the row with the
    smallest id stays; of several rows with that id one stays. Null ids come after all others; a group of null ids
    only has a null ``keep_id`` and keeps one row. An empty table gives an empty result. Other columns are not read.
    ``key`` replaces the 64-bit key of column ``norm`` (tests force collisions with it).
    """
    if id_col == text_col:
        raise ValueError("id and text must be different columns")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("key", (key if key is not None else F.xxhash64("norm")).cast("bigint"))
    rows = rows.withColumn("slot", F.shiftrightunsigned("key", KEY_BITS - max_depth).cast("int"))

    # an id and a key go with every text; they count, so that very many empty texts split too
    cells = rows.groupBy("slot").agg(F.sum(F.octet_length("norm") + F.lit(24)).alias("bytes")).collect()
    sizes = np.zeros(1 << max_depth, dtype=np.int64)
    for cell in cells:
        sizes[cell["slot"]] = cell["bytes"]
    total = int(sizes.sum())
    capacity = max(least_bucket, min(most_bucket, total >> 8), total >> (max_depth - 1))
    directory = spark.createDataFrame(build_directory(sizes, max_depth, capacity), "slot int, bucket int, pages int")

    # the directory has 2^max_depth rows (65,536 by default) at any size of the input
    placed = rows.join(F.broadcast(directory), "slot").drop("slot")
    placed = placed.withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages").cast("bigint")).cast("int"))
    owned = placed.repartition("bucket", "page")
    chain = Window.partitionBy("bucket", "page", "key").orderBy("norm")
    link = Window.partitionBy("bucket", "page", "key", "norm").orderBy(F.col("id").asc_nulls_last())
    whole = link.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    index = owned.select(
        "id", "bucket", "page", "pages", "key",
        F.dense_rank().over(chain).alias("link"),
        F.row_number().over(link).alias("place"),
        F.first("id").over(whole).alias("head"),
        F.count(F.lit(1)).over(whole).alias("n"),
        "norm",
    ).select(
        "id", "bucket", "page", "pages", "key", "link", "place", "head", "n",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.when((F.col("pages") > 1) & (F.col("place") == 1), F.col("norm")).alias("head_text"),
    )
    index = materialize(index, "dedup_index")

    same = Window.partitionBy("key", "head_text")
    heads = index.where((F.col("pages") > 1) & (F.col("place") == 1)).select(
        "bucket", "page", "key", "link",
        F.min("head").over(same).alias("group_head"),
        F.sum("n").over(same).alias("group_n"),
        # of pages whose first rows all have no id, one keeps its row
        F.row_number().over(same.orderBy(F.col("head").asc_nulls_last(), "page")).alias("page_place"),
    )
    joined = index.drop("head_text").join(heads, ["bucket", "page", "key", "link"], "left")
    paged = F.col("page_place").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(paged, F.col("group_head")).otherwise(F.col("head")).alias("keep_id"),
        F.when(paged, F.col("group_n")).otherwise(F.col("n")).alias("group_size"),
        ((F.col("place") == 1) & (~paged | (F.col("page_place") == 1))).alias("kept"),
        "text_sha256",
    )
