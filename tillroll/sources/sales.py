"""Typed scan of raw sales (O1), with rejected records, the table sink, and the CSV report sinks (O18)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.money import parse_money
from tillroll.sources.tables import swap_catalog_table

# Raw item-grain sales: one row per drink sold.
SALES_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("hour_of_day", T.LongType()),
    T.StructField("cash_type", T.StringType()),
    T.StructField("card", T.StringType()),
    T.StructField("money", T.StringType()),
    T.StructField("coffee_name", T.StringType()),
    T.StructField("Time_of_Day", T.StringType()),
    T.StructField("Weekday", T.StringType()),
    T.StructField("Month_name", T.StringType()),
    T.StructField("Weekdaysort", T.LongType()),
    T.StructField("Monthsort", T.LongType()),
])


def read_sales(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = SALES_SCHEMA,
               **options: str) -> DataFrame:
    """Scan raw sales with an explicit schema (no inference pass over the data).

    ``fmt`` is any Spark source (``parquet``, ``csv``, ``json``, ``orc``). For CSV,
    ``header`` defaults to true. Spreadsheet files have no Spark source: convert
    them to CSV or Parquet first.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        options.setdefault("header", "true")
    reader = reader.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


REASON = "reject_reason"
RAW = "raw_record"


def read_sales_csv(spark: SparkSession, path: str, schema: T.StructType = SALES_SCHEMA, strict: bool = False,
                   money: str | None = "money", **options: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows) of raw sales in CSV: nothing becomes NULL unseen.

    A record is rejected if it has too few or too many fields, if a field does not read as its column's type, or if its
    ``money`` text is no amount. Rejected rows have the record as it was (``raw_record``) and why (``reject_reason``).
    ``strict`` fails on the first such record instead, when the rows are read. Empty fields are NULL and no reason.
    """
    options = {"header": "true", **options}
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    corrupt = as_text.add(RAW, T.StringType())
    # every field as text first: what a typed reader would turn into NULL stays to be told
    rows = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, **options).schema(corrupt).csv(path)
    typed = {f.name: F.col(f.name) if isinstance(f.dataType, T.StringType) else _typed(F.col(f.name), f.dataType)
             for f in schema.fields}
    reasons = [F.when(F.col(RAW).isNotNull(), F.lit("fields"))]
    reasons += [F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.lit(f.name)) for f in schema.fields
                if not isinstance(f.dataType, T.StringType)]
    if money in typed:
        reasons.append(F.when(F.col(money).isNotNull() & parse_money(money, strict=False).isNull(), F.lit(money)))
    why = F.concat_ws(", ", *reasons)
    rows = rows.select("*", why.alias(REASON))
    if strict:
        bad = F.raise_error(F.concat(F.lit("rejected record ("), F.col(REASON), F.lit("): "),
                                     F.coalesce(RAW, F.to_json(F.struct(*schema.names)))))
        rows = rows.withColumn(REASON, F.when(F.col(REASON) != "", bad.cast("string")).otherwise(F.lit("")))
    good = rows.where(F.col(REASON) == "").select(*(c.alias(name) for name, c in typed.items()))
    rejected = rows.where(F.col(REASON) != "").select(
        F.coalesce(F.col(RAW), F.to_json(F.struct(*schema.names))).alias(RAW), REASON)
    return good, rejected


def _typed(text: Column, kind: T.DataType) -> Column:
    return F.trim(text).try_cast(kind)


def write_table(df: DataFrame, target: str, fmt: str = "parquet") -> None:
    """Create or replace a table: a path (``/``, ``:`` in it) holds files, anything else is a catalog table name.

    The new table is written aside and takes the old one's name when it is whole, so a write that fails leaves the old
    one, and a table can be rebuilt from itself. A path changes hands in two renames; readers and writers at the same
    time need ``tillroll.sources.tables.replace_table``.
    """
    if not ("/" in target or ":" in target):
        swap_catalog_table(df, target, lambda w: w.format(fmt))
        return
    spark, target = df.sparkSession, target.rstrip("/")
    parent, _, name = target.rpartition("/")
    path = spark._jvm.org.apache.hadoop.fs.Path
    staged, old = (path(f"{parent}/.{name}-{role}-{uuid.uuid4().hex}") for role in ("new", "old"))
    files = path(target).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        df.write.format(fmt).save(staged.toString())
    except BaseException:
        files.delete(staged, True)
        raise
    had = files.exists(path(target))
    if had and not files.rename(path(target), old):
        raise OSError(f"cannot move the old table at {target}")
    if not files.rename(staged, path(target)):
        if had:
            files.rename(old, path(target))
        raise OSError(f"cannot move the new table to {target}")
    if had:
        files.delete(old, True)


def write_checked(df: DataFrame, target: str, rules: dict[str, Column], write=None) -> dict[str, int]:
    """Writes ``df`` (by ``write_table`` unless ``write(df, target)`` is given) and returns, for each rule, how many of
    the rows written break it: counted while they are written, without a second scan."""
    seen = Observation(f"rules-{uuid.uuid4().hex}")
    names = list(rules)
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"),
                         *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())))
    (write or write_table)(watched, target)
    counts = seen.get
    return {"rows": counts["rows"], **{name: counts[f"r{i}"] for i, name in enumerate(names)}}


MANIFEST = "manifest"


def export_ordered(df: DataFrame, path: str, keys: Sequence[str | Column], rows_per_part: int = 1_000_000) -> int:
    """Writes a result set of any size as CSV parts that, read in order of their names, give its rows in order of
    ``keys``; returns the number of rows.

    Rows are range-partitioned, so every part is sorted by its own task and no task holds them all. The folder
    ``manifest`` beside the folder ``parts`` lists the parts in order, with their number of rows and the first row's
    place. Of rows with equal keys the order is not defined.
    """
    if rows_per_part < 1:
        raise ValueError(f"rows_per_part must be 1 or more, not {rows_per_part!r}")
    spark, path = df.sparkSession, path.rstrip("/")
    total = df.count()
    parts = max(1, -(-total // rows_per_part))
    by = [F.col(k) if isinstance(k, str) else k for k in keys]
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by) if parts > 1 else df.coalesce(1).sortWithinPartitions(*by)
    # Spark names its files part-<number of the task>-..., and tasks follow the ranges
    ordered.write.mode("overwrite").option("header", "true").csv(f"{path}/parts")
    written = spark.read.option("header", "true").schema(", ".join(f"c{i} string" for i in range(len(df.columns)))).csv(
        f"{path}/parts").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part"))
    listed = written.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # one row for each part
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    listed.select("part", "rows", before.alias("first_row")).coalesce(1).sortWithinPartitions("part").write.mode(
        "overwrite").option("header", "true").csv(f"{path}/{MANIFEST}")
    return total


def read_ordered(spark: SparkSession, path: str) -> list[str]:
    """Paths of the parts of an ordered export, in order."""
    rows = spark.read.option("header", "true").csv(f"{path.rstrip('/')}/{MANIFEST}").orderBy("part").collect()
    return [f"{path.rstrip('/')}/parts/{r['part']}" for r in rows]


def export_report(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Write a result set as CSV with a header row.

    Output is one file per partition; ``single_file`` coalesces first and is
    meant for small, already aggregated reports only.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", "true").csv(path)
