"""The corpus pipeline: each stage applies one operator of ``tillroll.llm`` to what the stage before it kept.

quality classifier -> toxicity -> exact dedup -> n-gram Jaccard join -> best-fit packing. All but the last stage return
the columns of ``documents``, of the rows that stay; the last returns the packed pieces. The two classifiers learn from
the table ``labels``, never from its held-out fold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.exact_dedup import exact_dedup, normalised
from tillroll.llm.jaccard_join import jaccard_join
from tillroll.llm.packing import best_fit_packing
from tillroll.llm.quality import resample
from tillroll.llm.queries import learned_labels
from tillroll.llm.toxicity import score_toxicity
from tillroll.session import checkpoint_root

# the n-gram models, the softmax, the path sampling and the packing have no SQL form
ORACLE_SQL = None


ROWS_PER_BATCH = 1000  # sent to a Python worker at once; rows carry their text twice


def _with_row(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row as one column, so that no column name can clash."""
    conf, most = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(most)) <= ROWS_PER_BATCH:
        conf.set(most, str(ROWS_PER_BATCH))
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws.

    Null and empty texts have weight 0 (log) like any other text without n-grams; texts of any length are weighed
    whole. Rows of one id and text share their draw, so ties and repeated rows stay or go together, as do rows without
    an id and of one text. Rows that stay keep all columns, of any name. No documents give no rows; without labels of
    both kinds every document stays.
    """
    return resample(_with_row(docs), learned_labels(spark, sf_dir), carry=["row"]).where("kept").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic.

    Null and empty texts are judged as a passage whose words say nothing; the worst passage decides for texts of any
    length. Equal texts have equal scores, so ties and repeated rows stay or go together; ids are not read, null ones
    included. Rows that stay keep all columns, of any name. No documents give no rows; with labels of one kind only,
    every text gets that kind.
    """
    scored = score_toxicity(_with_row(docs), learned_labels(spark, sf_dir), carry=["row"])
    return scored.where("predicted = 0").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id; of rows with one id and text one.

    Null texts count as empty, and a row without an id stays only where no row with one has its text. Texts are
    compared whole. The row that stays keeps all columns, of any name. No documents give no rows.
    """
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_hash"))
    rows = _with_row(docs).select("doc_id", F.sha2(normalised("text").cast("binary"), 256).alias("hash"), "row")
    same = Window.partitionBy("doc_id", "hash").orderBy(F.xxhash64("row"))
    both = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    return rows.join(kept, both).withColumn("place", F.row_number().over(same)).where("place = 1").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id.

    Null, empty and blank texts are each a class of their own and stay; a text under five words is one shingle. Texts
    of any length are compared whole. Of repeated rows with words one stays. Rows that stay keep all columns, of any
    name. No documents give no rows.
    """
    return jaccard_join(_with_row(docs), carry=["row"], count_links=False).where("kept").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens.

    Null and empty texts are their end id alone; longer texts than a sequence are cut into pieces. Repeated rows and
    rows without an id are packed as documents of their own. Other columns are not read. No documents give no rows.
    """
    return best_fit_packing(_with_row(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
