"""Sharding along a Hilbert curve through several metadata dimensions, with DataFrame functions only.

1. *Classes.* Each dimension gives every row one of at most ``CLASSES`` classes: equal ranges of the id, logarithmic
   ranges of the size, hash classes of a category. A narrow table keeps them with a 64-bit hash of the row.
2. *Levels.* Classes are counted and cut into 2^bits levels of about equally many rows.
3. *Curve.* A cell is a combination of levels. Cells are counted (at most 2^(bits x dimensions) rows, whatever the
   input) and get their Hilbert index, so that running totals along the curve tell where every cell starts. A large
   cell is cut into pieces by ranges of the row hash.
4. *Runs.* Rows take their piece's start from a directory of bounded size and are exchanged once, by runs of
   neighbouring pieces. The place in a piece is a row number in order of the hash; start plus place is the row's
   position on the curve, and positions are cut into shards whose counts differ by one at most (law ``rows``).

Rows that are equal in every column share one hash, which no range parts; where there are very many of them (more than a
piece may hold), one of them stands for all, and its copies are made where they are written.

``write_shards`` writes one folder of Parquet files for each shard, in order of the curve, so that the ranges of the
metadata in a shard (``shard_ranges``) and in its row groups are narrow in every dimension at once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import materialize, text_of
from tillroll.session import checkpoint_root

SHARDS = 24
BITS = 4  # levels of a dimension: 2^BITS
CLASSES = 4096
MOST_CELLS = 1 << 16
LEAST_PIECE = 4096  # rows
RUNS = 1 << 12
EXTRA = 8  # bytes of a document besides its text


def document_size(text_col: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.octet_length(text_of(text_col)) + F.lit(EXTRA)).cast("bigint")


def _log_class(n: Column) -> Column:
    """Class of a number from 8 on: its bit length and the three bits below the first one."""
    bits = F.length(F.bin(n))
    return (bits * 8 + F.call_function("shiftright", n, bits - 4) % 8).cast("int")


def _hash_class(c: Column) -> Column:
    return F.when(c.isNull(), -1).otherwise(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(CLASSES))).cast("int")


def _range_class(c: Column, least: int, most: int) -> Column:
    """Equal ranges of a whole number; null before all."""
    wide = c.cast("decimal(38,0)") - F.lit(str(least)).cast("decimal(38,0)")
    width = F.lit(str(-(-(most - least + 1) // CLASSES))).cast("decimal(38,0)")
    return F.when(c.isNull(), -1).otherwise(F.floor(wide / width)).cast("int")


def hilbert_index(axes: Sequence[Column], bits: int, df: DataFrame, name: str = "curve") -> DataFrame:
    """``df`` with the distance along the Hilbert curve of the point whose coordinates (``bits`` bits each) are the
    columns ``axes``: the transposed form of Skilling ("Programming the Hilbert curve", 2004), then bits interleaved."""
    n = len(axes)
    x = [f"__x{i}" for i in range(n)]
    df = df.select("*", *(a.cast("bigint").alias(x[i]) for i, a in enumerate(axes)))

    def step(changes: dict[str, Column]) -> None:
        nonlocal df
        df = df.withColumns(changes)

    first = F.col(x[0])
    for level in range(bits - 1, 0, -1):
        low = F.lit((1 << level) - 1).cast("bigint")
        for i, axis in enumerate(x):
            own = F.col(axis)
            is_set = own.bitwiseAND(F.lit(1 << level).cast("bigint")) != 0
            swap = F.when(is_set, F.lit(0)).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
            flipped = F.when(is_set, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
            step({x[0]: flipped} if i == 0 else {x[0]: flipped, axis: own.bitwiseXOR(swap)})
    for i in range(1, n):
        step({x[i]: F.col(x[i]).bitwiseXOR(F.col(x[i - 1]))})
    turn = F.lit(0).cast("bigint")
    for level in range(bits - 1, 0, -1):
        bit = F.col(x[-1]).bitwiseAND(F.lit(1 << level).cast("bigint")) != 0
        turn = turn.bitwiseXOR(F.when(bit, F.lit((1 << level) - 1)).otherwise(F.lit(0)).cast("bigint"))
    step({"__turn": turn})
    index = F.lit(0).cast("bigint")
    for level in range(bits - 1, -1, -1):
        for axis in x:
            bit = F.shiftright(F.col(axis).bitwiseXOR(F.col("__turn")), level).bitwiseAND(F.lit(1).cast("bigint"))
            index = index * 2 + bit
    return df.withColumn(name, index).drop(*x, "__turn")


def _classed(docs: DataFrame, id_col: str, text_col: str, categories: Sequence[str]) -> tuple[DataFrame, int]:
    """``docs`` as ``row``, its ``hash`` and its classes ``c0``, ``c1``, ...; and the number of dimensions."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    own = [F.col("row").getField(c) for c in docs.columns]
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        ends = docs.agg(F.min(id_col).alias("least"), F.max(id_col).alias("most")).first()
        least, most = ends["least"] or 0, ends["most"] or 0
        of_id = _range_class(F.col("row").getField(id_col), least, most)
    else:
        of_id = _hash_class(F.col("row").getField(id_col))
    size = (F.octet_length(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))) + F.lit(EXTRA)).cast("bigint")
    classes = [of_id, _log_class(size), *(_hash_class(F.col("row").getField(c)) for c in categories)]
    # nulls leave a hash as it was, so each column is hashed with its place
    marked = [F.coalesce(c.cast("string"), F.lit(f"null {i}")) if not isinstance(f.dataType, T.StringType)
              else F.struct(c, c.isNull()) for i, (c, f) in enumerate(zip(own, docs.schema.fields, strict=True))]
    return rows.select("row", F.xxhash64(*marked).alias("hash"),
                       *(c.alias(f"c{i}") for i, c in enumerate(classes))), len(classes)


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                 categories: Sequence[str] = ("lang", "source"), *, shards: int = SHARDS, bits: int = BITS,
                 least_piece: int = LEAST_PIECE) -> DataFrame:
    """Writes ``docs`` to ``folder`` as Parquet, one subfolder ``shard=k`` for each shard that has rows, in order of the
    curve; returns the files read again: the columns of ``docs`` and ``shard`` (int), ``slot`` (bigint, gapless from 0
    in the shard). A column of ``docs`` with one of those names gets ``_`` at its end.

    Shards hold runs of the curve; their row counts differ by one at most, the larger ones first, so with fewer rows
    than shards each of the first has one. Null ids, texts and categories are classes of their own or, of texts, empty.
    Repeated rows are different rows. Equal texts are near each other only if their metadata are. The same rows get the
    same shards and slots however they are partitioned. An empty table gives no rows.
    """
    if bits * (2 + len(categories)) > math.log2(MOST_CELLS):
        raise ValueError(f"more than {MOST_CELLS} cells: use fewer bits or categories")
    spark = docs.sparkSession
    classed, n = _classed(docs, id_col, text_col, categories)
    narrow = materialize(classed.drop("row"), "shard_classes")

    # a row for each dimension and class, at most CLASSES + 1 of a dimension
    of_class = narrow.select(F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"c{i}").alias("class"))
                                                 for i in range(n)))).alias("r")).groupBy("r.dim", "r.class").agg(
        F.count(F.lit(1)).alias("rows"))
    along = Window.partitionBy("dim").orderBy("class")
    whole = F.sum("rows").over(Window.partitionBy("dim"))
    before = F.sum("rows").over(along) - F.col("rows")
    # by the middle of the class, so that one which holds most rows does not push the others to one side
    levels = materialize(of_class.select("dim", "class", F.floor(
        (before + F.col("rows") / 2) * (1 << bits) / whole).cast("int").alias("level")), "shard_levels")

    def levelled(df: DataFrame) -> DataFrame:
        for i in range(n):
            own = levels.where(F.col("dim") == i).select(F.col("class").alias(f"c{i}"), F.col("level").alias(f"l{i}"))
            df = df.join(F.broadcast(own), f"c{i}").drop(f"c{i}")
        return df

    at = [f"l{i}" for i in range(n)]
    placed = levelled(narrow)
    cells = hilbert_index([F.col(c) for c in at], bits, placed.groupBy(*at).agg(F.count(F.lit(1)).alias("rows")))
    cells = materialize(cells, "shard_cells")  # at most MOST_CELLS rows
    total = cells.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    most = max(least_piece, total // MOST_CELLS)
    cells = cells.withColumn("cut", F.ceil(F.col("rows") / F.lit(most)).cast("int")).drop("rows")

    def pieced(df: DataFrame) -> DataFrame:
        """Rows with ``curve`` and ``piece``: ranges of the upper 32 bits of the hash."""
        upper = F.shiftrightunsigned("hash", 32)
        return df.join(F.broadcast(cells), at).withColumn(
            "piece", F.shiftrightunsigned(upper * F.col("cut"), 32).cast("int")).drop("cut", *at)

    sizes = materialize(pieced(placed).groupBy("curve", "piece").agg(F.count(F.lit(1)).alias("rows")), "shard_pieces")
    # rows that are equal in every column, where more of them than half a piece share one: at most 2 total / most
    tied = pieced(placed).join(F.broadcast(sizes.where(F.col("rows") > 2 * most).select("curve", "piece")),
                               ["curve", "piece"], "left_semi")
    tied = materialize(tied.groupBy("curve", "piece", "hash").agg(F.count(F.lit(1)).alias("copies")).where(
        F.col("copies") > most // 2), "shard_ties")

    # at most MOST_CELLS + total / most <= 2 MOST_CELLS pieces: one task numbers them, every task may hold them
    along = Window.orderBy("curve", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum("rows").over(along) - F.col("rows")
    directory = sizes.select("curve", "piece", start.alias("start")).withColumn(
        "run", F.floor(F.col("start") * F.lit(RUNS) / F.lit(max(total, 1))).cast("int"))
    directory = materialize(directory, "shard_directory")

    rows = pieced(levelled(classed)).join(F.broadcast(directory), ["curve", "piece"])
    inside = Window.partitionBy("run", "curve", "piece").orderBy("hash")
    if tied.isEmpty():
        numbered = rows.repartition("run").withColumn("place", F.row_number().over(inside) - 1)
    else:
        numbered = _with_ties(rows, tied, inside, most)
    position = F.col("start") + F.col("place")
    small, larger = divmod(total, shards)  # the first `larger` shards have one row more
    edge = larger * (small + 1)
    numbered = numbered.withColumn("position", position.cast("bigint"))
    shard = F.when(F.col("position") < edge, F.expr(f"position div {small + 1}")).otherwise(
        F.expr(f"{larger} + (position - {edge}) div {max(small, 1)}"))
    numbered = numbered.withColumn("shard", shard.cast("int"))
    slot = F.col("position") - F.col("shard") * small - F.least(F.col("shard"), F.lit(larger))
    taken = {c: c + "_" if c in ("shard", "slot") else c for c in docs.columns}
    out = numbered.select(*(F.col("row").getField(c).alias(name) for c, name in taken.items()), "shard",
                          slot.cast("bigint").alias("slot"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder).select(*out.columns)


def _with_ties(rows: DataFrame, tied: DataFrame, inside: Window, most: int) -> DataFrame:
    """Rows with their ``place``, where some sets of equal rows are larger than a piece may be: each set goes as one row
    with the number of its copies, which takes as many places."""
    sets = F.broadcast(tied)  # bounded as the pieces are
    single = rows.join(sets, ["curve", "piece", "hash"], "left_anti").withColumn("copies", F.lit(1).cast("bigint"))
    one = rows.join(sets, ["curve", "piece", "hash"]).groupBy("curve", "piece", "hash", "copies").agg(
        F.any_value("row").alias("row"), F.any_value("start").alias("start"), F.any_value("run").alias("run"))
    both = single.unionByName(one).repartition("run")
    numbered = both.withColumn("first", F.sum("copies").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies"))
    alone = numbered.where("copies = 1").withColumn("place", F.col("first"))
    parts = F.ceil(F.col("copies") / F.lit(most)).cast("bigint")
    dealt = numbered.where("copies > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    end = F.least((F.col("part") + 1) * most, F.col("copies"))
    dealt = dealt.repartition("hash", "part").withColumn("place", F.explode(F.sequence(
        F.col("first") + F.col("part") * most, F.col("first") + end - 1))).drop("part")
    return alone.unionByName(dealt)


def shard_ranges(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per shard its rows and, of each column, the least and the greatest value: what a reader prunes by."""
    return files.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *(
        f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))))


def shards_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of the shards written from ``docs``: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``,
    ``grown_shard``."""
    folder = f"{checkpoint_root(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}"
    files = write_shards(docs.select("*"), folder, id_col, text_col, **options)
    return files.select(
        F.col(id_col), document_size(text_col).alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
