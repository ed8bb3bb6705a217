"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import materialize

__all__ = ["HELD_OUT_FOLDS", "carried", "held_by_worker", "held_out", "labelled_sample", "materialize", "public_file", "table", "text_of", "uncarried", "utf8", "word_cache"]

HELD_OUT_FOLDS = 5  # crc32(doc_id as text) mod 5 = 0 is held out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(id_col: str) -> Column:
    """True for the rows whose crc32(id as text) mod 5 is 0; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT_FOLDS == 0


def public_file(name: str) -> bytes:
    """Content of a public tokenizer file, read on the driver and sent to the tasks (fixed, about 2 MB at most)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def carried(columns: Sequence[str]) -> Column:
    """Columns that an operator passes on unread, as one struct; see ``uncarried``."""
    return F.struct(F.lit(0).alias("none"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("carried")


def uncarried(columns: Sequence[str], taken: Sequence[str] = ()) -> list[Column]:
    """Those columns again, but for names that the result has already."""
    return [F.col(f"carried.c{i}").alias(c) for i, c in enumerate(columns) if c not in taken]


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, n: int,
                    seed: int = 0) -> list[tuple[object, str]]:
    """(label, text) of about n rows of each label, or all if it has fewer, chosen by a hash of the id.

    The rows are chosen among ``labels`` (id and label, no texts) whose id is in ``docs``, so only the chosen ids, about n for each label, go
    to the tasks that read the texts. Null labels are left out. Labels are a small set. In order of label and text.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull())
    own = own.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = own.join(sizes, "label").where(draw * F.col("of_label") < n).select("id", "label").dropDuplicates()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return sorted((r["label"], r["text"]) for r in rows.join(F.broadcast(chosen), "id").select("label", "text").collect())


def utf8(text: str) -> bytes:
    """UTF-8 bytes; a lone surrogate, which no Parquet text holds, becomes '?'."""
    return text.encode("utf-8", "replace")


_HELD: dict[object, object] = {}


def held_by_worker(key: object, make: Callable[[], object]) -> object:
    """State that a Python worker keeps for the tasks of one operator (caches, models). A worker serves many operators
    in turn, so the state of the one before goes: memory is that of one operator."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def word_cache(compute: Callable[[str], object], limit: int) -> dict:
    """A dict that computes missing entries and holds ``limit`` of them at most, so that its memory is bounded whatever
    the vocabulary: when half of that is new, what was there before goes, but for entries that were used again. Entries
    depend on the key only, so results do not depend on what is held."""

    class Cache(dict):
        older: dict = {}

        def __missing__(self, key):
            value = self.older.get(key)
            if value is None:
                value = compute(key)
            if 2 * len(self) >= limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
            return value

    return Cache()
