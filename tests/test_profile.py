"""Quartiles by range counting and typed distinct counts against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import quality
from tillroll.operators.quality import distinct_counts, numeric_describe, profile


def quartiles(values):
    return [round(float(np.percentile(values, q)), 6) for q in (25, 50, 75)]


@pytest.mark.parametrize("shape", ["normal", "ties", "tiny and huge", "one", "two"])
def test_quartiles_of_any_shape(spark, shape):
    rng = np.random.default_rng(3)
    values = {"normal": rng.normal(size=30_000), "ties": rng.choice([1.0, 2.0, 2.0, 2.0, 7.5], size=5001),
              "tiny and huge": rng.choice([-1.0, 1.0], size=4000) * 2.0 ** rng.integers(-300, 300, size=4000),
              "one": np.array([4.5]), "two": np.array([-1.0, 2.0])}[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    row = numeric_describe(df).first()
    want = np.percentile(values, [25, 50, 75])
    assert [row["q25"], row["q50"], row["q75"]] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-6)
    assert row["count"] == len(values) and row["min"] == values.min() and row["max"] == values.max()


def test_quartiles_in_many_passes(spark, monkeypatch):
    """Brackets are narrowed again and again, and cuts that miss the rank are mended."""
    monkeypatch.setattr(quality, "_LAST", 3)
    monkeypatch.setattr(quality, "_CUTS", 4)
    monkeypatch.setattr(quality, "_NEAR", 0.0)
    values = np.random.default_rng(8).normal(size=2000).round(3)
    df = spark.createDataFrame([(float(v), i % 7) for i, v in enumerate(values)], "v double, k int")
    rows = {r["column_name"]: r for r in numeric_describe(df).collect()}
    assert [rows["v"][q] for q in ("q25", "q50", "q75")] == pytest.approx(np.percentile(values, [25, 50, 75]).tolist())
    assert [rows["k"][q] for q in ("q25", "q50", "q75")] == quartiles([i % 7 for i in range(2000)])


def test_quartiles_with_missing_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, 1.0, None), (1, nan, None), (2, -inf, None), (3, 2.0, None), (4, 5.0, None), (None, nan, None)]
    got = {r["column_name"]: r for r in numeric_describe(spark.createDataFrame(rows, "a int, b float, c double")).collect()}
    assert [got["a"][q] for q in ("q25", "q50", "q75")] == quartiles([1, 2, 3, 4])
    assert got["b"]["q50"] == 3.5 and np.isnan(got["b"]["q75"])  # NaN ranks last
    assert got["c"]["count"] == 0 and got["c"]["q50"] is None
    empty = numeric_describe(spark.createDataFrame([], "a int")).first()
    assert empty["count"] == 0 and empty["q25"] is None


def test_passes_exchange_no_values(spark):
    """All a pass hands on is one row of aggregates for each task."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("__x0"))
    seen = []

    class Spy:
        def selectExpr(self, *exprs):
            return Inside(df.selectExpr(*exprs))

    class Inside:
        def __init__(self, inner):
            self.inner = inner

        def selectExpr(self, *exprs):
            out = self.inner.selectExpr(*exprs)
            seen.append(out._jdf.queryExecution().executedPlan().toString())
            return out

    quality._count_ranges(Spy(), [(0, 100.0, 200.0)], [False])
    assert "SinglePartition" in seen[0] and "hashpartitioning" not in seen[0] and "rangepartitioning" not in seen[0]


def test_distinct_counts_equal_count_distinct(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, -0.0, 1.0, float("nan"), -float("nan"), None]), rng.choice(["a", "A", "", None]),
             rng.choice([1, 2, None]), rng.choice([True, False]), bytearray(rng.choice([b"\x00", b"\x00\x00"])),
             [rng.choice([1, 2])]) for _ in range(200)]
    df = spark.createDataFrame(rows, "f double, s string, i int, b boolean, y binary, l array<int>").select(
        "*", F.col("f").cast("float").alias("g"), F.col("i").cast("decimal(9,2)").alias("d"),
        F.date_add(F.lit("2024-01-01"), F.coalesce("i", F.lit(5))).alias("day"),
        F.timestamp_add("DAY", F.coalesce("i", F.lit(5)), F.lit("2024-01-01").cast("timestamp_ntz")).alias("t"))
    want = df.agg(*(F.countDistinct(c).alias(c) for c in df.columns)).first().asDict()
    assert {r["column_name"]: r["distinct_count"] for r in distinct_counts(df).collect()} == want
    assert want["f"] == 3 and [r["column_name"] for r in distinct_counts(df).collect()] == df.columns
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "f double")
    assert distinct_counts(zeros).first()["distinct_count"] == 2
    assert {r["metric"]: r["value"] for r in profile(zeros).collect()}["distinct"] == 2.0


def test_profile_of_texts_only(spark):
    df = spark.createDataFrame([("a",), (None,)], "s string")
    got = {r["metric"]: r["value"] for r in profile(df).collect()}
    assert got == {"rows": 2.0, "non_null": 1.0, "nulls": 1.0, "null_pct": 50.0, "distinct": 1.0}
