"""Order grouping: hand-made edge rows and a property test of both forms."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tillroll.operators.orders import sessionize_orders

SCHEMA = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("card", T.StringType()),
    T.StructField("cash_type", T.StringType()),
    T.StructField("coffee_name", T.StringType()),
    T.StructField("money", T.DoubleType()),
])
T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


def _s(seconds, micros=0):
    return T0 + dt.timedelta(seconds=seconds, microseconds=micros)


def _orders(spark, rows, method, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    if method == "narrow":  # chunks narrower than the gap
        method, kw = "chunked", {**kw, "chunk_seconds": 120}
    if method == "dense":  # chunks of one or two items
        method, kw = "density", {**kw, "chunk_rows": 2}
    out = sessionize_orders(df, method=method, keep_helpers=True, tie_break=["coffee_name", "money"], **kw)
    got = [(r.datetime, r.coffee_name, r.customer_key, r.order_group_id, r.order_id, r.total_products_in_order,
            r.total_value_of_order, r.previous_datetime, r.time_diff_seconds) for r in out.collect()]
    return sorted(got, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("method", ["window", "chunked", "narrow", "dense"])
def test_gap_boundaries(spark, method):
    # gaps: 300.000 s (new order), then 299.999 s twice (joined)
    rows = [(_s(0), "A", "card", "x", 1.0), (_s(300), "A", "card", "y", 2.0),
            (_s(599, 999000), "A", "card", "z", 3.0), (_s(899, 998000), "A", "card", "w", 4.0)]
    got = _orders(spark, rows, method)
    ids = [g[3] for g in got]
    assert ids == [1, 2, 2, 2]
    assert [g[5] for g in got] == [1, 3, 3, 3]
    assert [g[6] for g in got] == [1.0, 9.0, 9.0, 9.0]
    assert got[1][4] == "2024-03-01 10:05:00.000000+00_A"
    assert [g[8] for g in got] == [None, 300, 299, 299]


@pytest.mark.parametrize("method", ["window", "chunked", "narrow", "dense"])
def test_whole_seconds_not_clock_boundaries(spark, method):
    rows = [(_s(0, 900000), "A", "card", "x", 1.0), (_s(300, 100000), "A", "card", "y", 2.0)]
    got = _orders(spark, rows, method)
    assert {g[4] for g in got} == {"2024-03-01 10:00:00.900000+00_A"}
    assert got[1][8] == 299


@pytest.mark.parametrize("method", ["window", "chunked", "narrow", "dense"])
def test_ties_share_one_order(spark, method):
    rows = [(_s(0), "A", "card", "x", 1.5), (_s(0), "A", "card", "y", 2.25), (_s(1000), "A", "card", "z", 1.0)]
    got = _orders(spark, rows, method)
    assert [g[3] for g in got] == [1, 1, 2]
    assert [g[5] for g in got] == [2, 2, 1]
    assert [g[6] for g in got] == [3.75, 3.75, 1.0]
    assert [g[8] for g in got] == [None, 0, 1000]


@pytest.mark.parametrize("method", ["window", "chunked", "narrow", "dense"])
def test_cash_and_null_keys(spark, method):
    rows = [(_s(0), None, "cash", "x", 1.0), (_s(10), None, "cash", "y", 2.0),
            (_s(0), None, None, "x", 5.0), (_s(20), None, None, "y", 6.0)]
    got = _orders(spark, rows, method)
    keys = sorted({(g[2], g[4], g[5], g[6]) for g in got}, key=str)
    assert (None, None, 2, 11.0) in keys
    assert ("CASH_cash", "2024-03-01 10:00:00.000000+00_CASH_cash", 2, 3.0) in keys


@pytest.mark.parametrize("chunk", [86_400, 1, 300, 10**9])
def test_methods_agree_on_test_data(spark, chunk):
    from tillroll.plans.catalog import sales_clean
    c = sales_clean(spark, "/root/testdata/sf0.001")
    w = sessionize_orders(c, method="window", keep_helpers=True, tie_break=["coffee_name", "money"])
    k = sessionize_orders(c, method="chunked", keep_helpers=True, tie_break=["coffee_name", "money"], chunk_seconds=chunk)
    assert w.exceptAll(k).count() == 0 and k.exceptAll(w).count() == 0


@pytest.mark.parametrize("chunk_rows", [1, 7, 100, 10**6])
def test_density_agrees_on_test_data(spark, chunk_rows):
    from tillroll.plans.catalog import sales_clean
    c = sales_clean(spark, "/root/testdata/sf0.001")
    w = sessionize_orders(c, method="window", keep_helpers=True, tie_break=["coffee_name", "money"])
    k = sessionize_orders(c, keep_helpers=True, tie_break=["coffee_name", "money"], chunk_rows=chunk_rows)
    assert w.exceptAll(k).count() == 0 and k.exceptAll(w).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 5_000_000), st.integers(0, 3)), min_size=1, max_size=40))
def test_chunked_equals_window(spark, events):
    """Random customers, times (ms steps near the 300 s edges) and prices."""
    rows = []
    for i, (cust, ms, price) in enumerate(events):
        card = None if cust == 0 else f"C{cust}"
        rows.append((T0 + dt.timedelta(milliseconds=ms * 7), card, "cash" if card is None else "card",
                     f"p{i}", float(price) + 0.25))
    assert _orders(spark, rows, "window") == _orders(spark, rows, "chunked") == _orders(spark, rows, "narrow")
    assert _orders(spark, rows, "dense") == _orders(spark, rows, "window")


def test_item_rows_partition_input(spark):
    from pyspark.sql import functions as F
    from tillroll.plans.catalog import transactions
    tx = transactions(spark, "/root/testdata/sf0.001")
    per_order = tx.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.max("total_products_in_order").alias("t"),
                                           F.sum(F.col("money").cast("decimal(18,2)")).alias("m"),
                                           F.max("total_value_of_order").alias("v"))
    bad = per_order.filter((F.col("n") != F.col("t")) | (F.col("m").cast("double") != F.col("v")))
    assert bad.count() == 0
    assert tx.count() == 1280
    assert tx.select("order_id").distinct().count() == 1020


def test_null_timestamps_agree(spark):
    rows = [(None, "A", "card", "x", 1.0), (None, "A", "card", "y", 2.0), (_s(0), "A", "card", "z", 3.0),
            (_s(100), "A", "card", "w", 4.0), (None, None, None, "v", 5.0)]
    assert _orders(spark, rows, "window") == _orders(spark, rows, "chunked") == _orders(spark, rows, "narrow")
    assert _orders(spark, rows, "dense") == _orders(spark, rows, "window")


@pytest.mark.parametrize("bad", [{"gap_seconds": 0}, {"gap_seconds": -5}, {"gap_seconds": 2.5}, {"chunk_seconds": 0}, {"chunk_rows": 0}])
def test_rejects_bad_parameters(spark, bad):
    df = spark.createDataFrame([(_s(0), "A", "card", "x", 1.0)], SCHEMA)
    with pytest.raises(ValueError):
        sessionize_orders(df, **bad)
