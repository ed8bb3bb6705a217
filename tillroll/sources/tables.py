"""Stored tables: replacement that never loses the old table, and the layout of the order table.

``replace_table`` keeps every state of a table in a folder of its own, ``<path>/v-<n>-<id>``, and names the one that holds
in a marker file. A new state is written whole before the marker moves, in one rename. So a write that fails half-way, or
a lost driver, leaves the old table as it was; a table can be rebuilt from itself; and a reader that has begun goes on
with the state it began with, as the last ``keep`` states stay.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

MARKER = "_CURRENT"
WHOLE = "_WHOLE"  # in the folder of a state that was written to its end
_STATE = re.compile(r"v-(\d+)-[0-9a-f]+")


class _Folder:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self.path = path.rstrip("/")
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_whole(self, name: str, text: str) -> None:
        """Replaces a small file in one step: written aside, then renamed over the old one."""
        aside = self.at(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(aside)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        kinds[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.conf).rename(
            self.fs.makeQualified(aside), self.fs.makeQualified(self.at(name)), kinds)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at())) if self.fs.exists(self.at()) else []


def current_state(spark: SparkSession, path: str) -> str | None:
    """Folder name of the state that holds, or None where there is no table yet."""
    return _Folder(spark, path).read(MARKER)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), keep: int = 2) -> int:
    """Create or replace the table at ``path`` with ``df`` (which may read that very table); returns its number.

    Two writers at once each write a state of their own; the marker's last move wins. The last ``keep`` states that are
    whole stay; older ones are removed, with what failed writes left between them.
    """
    if keep < 1:
        raise ValueError(f"keep must be 1 or more, not {keep!r}")
    folder = _Folder(df.sparkSession, path)
    known = [int(m[1]) for m in map(_STATE.fullmatch, folder.names()) if m]
    number = max(known, default=0) + 1
    state = f"v-{number}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder.path}/{state}")
    folder.write_whole(f"{state}/{WHOLE}", "")
    folder.write_whole(MARKER, state)
    states = {name: int(m[1]) for name in folder.names() if (m := _STATE.fullmatch(name))}
    whole = sorted(n for name, n in states.items() if folder.fs.exists(folder.at(name, WHOLE)))
    for name, n in states.items():
        if n < whole[-keep:][0]:
            folder.fs.delete(folder.at(name), True)
    return number


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its marker."""
    state = current_state(spark, path)
    if state is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{state}")


def _location(spark: SparkSession, name: str) -> str | None:
    """Where the files of a catalog table are; None if there is no such table."""
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else None


def swap_catalog_table(df: DataFrame, name: str, write: Callable[[DataFrameWriter], DataFrameWriter]) -> None:
    """Create or replace a catalog table with ``df`` (which may read that very table): the new one is written aside, in
    a folder of its own in the warehouse, then takes the name, then the old one's files go. ``write`` sets the format
    and layout of the writer. A write that fails leaves the old table."""
    spark, own = df.sparkSession, uuid.uuid4().hex[:12]
    staged = f"{name}__{own}"
    place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name.replace('.', '/')}-{own}"
    folder, old = _Folder(spark, place), _location(spark, name)
    try:
        write(df.write).option("path", place).saveAsTable(staged)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        folder.fs.delete(folder.at(), True)
        raise
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    if old is not None:
        gone = _Folder(spark, old)
        gone.fs.delete(gone.at(), True)


MONTH = "order_month"


def write_order_table(tx: DataFrame, name: str, customer: str = "card", date: str = "date", buckets: int = 64) -> DataFrame:
    """The order table as a catalog table in folders by month and in buckets by customer; returns it.

    Reports with a period cut-off skip whole months, given as ``order_month`` (see ``before_month``); reports that group
    by customer need no exchange, as a customer's rows are in one bucket. Rows without a customer are in one bucket as
    well, sorted first, so that a filter on the customer skips their row groups; reports on all rows read the files in
    splits, not by bucket. ``buckets`` is the number of tasks of such a report: about one for each 100 MB of the
    columns it reads.
    """
    rows = tx.withColumn(MONTH, F.date_format(date, "yyyy-MM"))

    swap_catalog_table(rows.repartition(buckets, customer, MONTH), name, lambda w: w.format("parquet").partitionBy(
        MONTH).bucketBy(buckets, customer).sortBy(customer))
    return tx.sparkSession.table(name)


def before_month(table: DataFrame, cutoff: str) -> DataFrame:
    """Rows of the months before that of ``cutoff`` (a date, the first of a month), by folders alone."""
    if not re.fullmatch(r"\d{4}-\d\d-01", cutoff):
        raise ValueError(f"the first day of a month (yyyy-mm-01), not {cutoff!r}")
    return table.where(F.col(MONTH) < cutoff[:7])
