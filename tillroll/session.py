"""Session construction and lineage cutting.

Jobs read ``spark.checkpoint.dir`` from the session (a shared folder on a
cluster). Where it is unset, as in tests and local benches, the caller names a
folder with ``use_scratch``; the library never picks one.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    app: str = "tillroll",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution on and a UTC clock.

    AQE coalesces small shuffle partitions, turns joins against small runtime
    results into broadcast joins after measuring them, and splits skewed join
    partitions. The UI is off: no server is started.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scale_conf(input_bytes: int, cores: int, split_bytes: int = 256 << 20,
               most_partitions: int = 100_000) -> dict[str, str]:
    """Partition sizing for a given input volume and core count.

    Scans read ``split_bytes`` per task. The initial shuffle partition count
    gives about 1 GiB of input per partition, at least two per core and at most
    ``most_partitions`` (the map x reduce shuffle block count grows with it; past
    that, about 98 TiB at the default, partitions grow beyond 1 GiB). Adaptive
    execution then coalesces small partitions toward half a split and splits
    join partitions over four times the median and over a split in size.
    For 100 TB on 8,000 cores: 256 MiB splits, 93,133 initial partitions.
    """
    partitions = min(max(math.ceil(input_bytes / (1 << 30)), 2 * cores), most_partitions)
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(split_bytes),
    }


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows known to the driver as a table; sent through Arrow, they are part of the plan and need no job."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    fields = to_arrow_schema(kinds)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), kinds)


_SCRATCH: dict[str, str] = {}


def use_scratch(spark: SparkSession, folder: str) -> None:
    """The folder to use in this application where ``spark.checkpoint.dir`` is unset (the setting itself cannot be
    changed once the session runs). Only sessions in local mode take one: it may be a machine-local folder."""
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder (e.g. on HDFS or object storage)")
    _SCRATCH[sc.applicationId] = folder


def has_root(spark: SparkSession) -> bool:
    """True if there is a folder for intermediate tables."""
    return bool(spark.conf.get(CHECKPOINT_CONF, None)) or spark.sparkContext.applicationId in _SCRATCH


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session (``spark.checkpoint.dir``), or by ``use_scratch`` where that
    is unset. Neither: an error, as a folder of the library's own choice would not survive a lost executor."""
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or _SCRATCH.get(sc.applicationId)
    if not root:
        raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder (e.g. on HDFS or object storage)")
    sc.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts lineage: a lost executor re-reads the written files instead of
    recomputing the whole upstream plan (e.g. the sessionised order table that
    every report reads).
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
