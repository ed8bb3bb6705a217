"""Report operators on small hand-made inputs and on the reference's own golden numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.basket import pair_counts, pair_rules
from tillroll.operators.customers import retention, rfm
from tillroll.operators.kpi import kpi_by, seasonality
from tillroll.operators.pricing import price_range
from tillroll.operators.quality import check_rules, distinct_counts, numeric_describe, profile, value_counts
from tillroll.operators.trends import deviation, growth

TX = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("coffee_name", T.StringType()),
    T.StructField("card", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("money", T.DoubleType()),
    T.StructField("total_products_in_order", T.LongType()),
    T.StructField("total_value_of_order", T.DoubleType()),
])


def _tx(spark, rows):
    full = []
    for oid, item, card, day, money, n, total in rows:
        full.append((oid, item, card, day, dt.datetime.combine(day, dt.time(12)), money, n, total))
    return spark.createDataFrame(full, TX)


def test_pairs_ignore_repeats_and_break_ties_by_name(spark):
    d = dt.date(2024, 3, 1)
    tx = _tx(spark, [
        ("o1", "Latte", "c", d, 1.0, 3, 3.0), ("o1", "Latte", "c", d, 1.0, 3, 3.0), ("o1", "Mocha", "c", d, 1.0, 3, 3.0),
        ("o2", "Americano", "c", d, 1.0, 2, 2.0), ("o2", "Latte", "c", d, 1.0, 2, 2.0),
        ("o3", "Espresso", "c", d, 1.0, 1, 1.0), ("o4", "Espresso", "c", d, 1.0, 1, 1.0),
    ])
    got = [tuple(r) for r in pair_counts(tx, k=1).collect()]
    assert got == [("Americano", "Latte", 1)]
    allp = sorted(tuple(r) for r in pair_counts(tx, k=None).collect())
    assert allp == [("Americano", "Latte", 1), ("Latte", "Mocha", 1)]
    rules = {(r.coffee_a, r.coffee_b): r for r in pair_rules(tx, k=None).collect()}
    r = rules[("Latte", "Mocha")]
    assert r.Support_AB == 1 / 4 and r.Confidence_A_to_B == 1 / 2 and r.Confidence_B_to_A == 1.0
    assert abs(r.Lift - (1 / 4) / ((2 / 4) * (1 / 4))) < 1e-12


def test_retention_any_earlier_vs_adjacent(spark):
    rows = [("a", "x", "A", dt.date(2024, 3, 5), 1.0, 1, 1.0), ("b", "x", "A", dt.date(2024, 5, 5), 1.0, 1, 1.0),
            ("c", "x", "B", dt.date(2024, 3, 6), 1.0, 1, 1.0), ("d", "x", "B", dt.date(2024, 4, 6), 1.0, 1, 1.0),
            ("e", "x", "C", dt.date(2024, 5, 7), 1.0, 1, 1.0), ("f", "x", None, dt.date(2024, 5, 7), 1.0, 1, 1.0)]
    tx = _tx(spark, rows)
    anyp = {r.period_month: tuple(r)[1:] for r in retention(tx).collect()}
    assert anyp == {"2024-04": (1, 2, 1, 50.0), "2024-05": (2, 1, 1, 100.0)}
    adj = {r.period_month: tuple(r)[1:] for r in retention(tx, adjacent=True).collect()}
    assert adj == {"2024-04": (1, 2, 1, 50.0), "2024-05": (2, 1, 0, 0.0)}
    cut = {r.period_month for r in retention(tx, cutoff="2024-05-01").collect()}
    assert cut == {"2024-04"}


def test_growth_first_period_and_drop(spark):
    rows = [("a", "x", "A", dt.date(2024, 3, 5), 10.0, 1, 10.0), ("b", "x", "A", dt.date(2024, 4, 5), 12.5, 1, 12.5),
            ("c", "x", "B", dt.date(2024, 4, 6), 2.5, 1, 2.5), ("d", "x", "B", dt.date(2024, 7, 1), 3.0, 1, 3.0)]
    tx = _tx(spark, rows)
    m = {r.sales_month: tuple(r)[1:] for r in growth(tx).collect()}
    assert m["2024-03"] == (1, 10.0, None, None)
    assert m["2024-04"] == (2, 15.0, 1.0, 0.5)
    assert m["2024-07"] == (1, 3.0, -0.5, -0.8)
    q = {r.sales_quarter: tuple(r)[1:] for r in growth(tx, period="quarter", drop_first=True).collect()}
    assert q == {"2024-Q2": (2, 15.0, 1.0, 0.5), "2024-Q3": (1, 3.0, -0.5, -0.8)}


def test_kpi_item_grain_overweights_multi_item_orders(spark):
    d = dt.date(2024, 3, 1)
    tx = _tx(spark, [("o1", "a", "c", d, 2.0, 2, 6.0), ("o1", "b", "c", d, 4.0, 2, 6.0), ("o2", "a", "c", d, 3.0, 1, 3.0)])
    item = kpi_by(tx, ["date"]).collect()[0]
    order = kpi_by(tx, ["date"], grain="order").collect()[0]
    assert (item.total_orders, item.total_items_sold, item.total_revenue, item.average_order_value,
            item.units_per_transaction) == (2, 3, 15.0, 5.0, 1.67)
    assert (order.total_revenue, order.average_order_value, order.units_per_transaction) == (9.0, 4.5, 1.5)
    s = seasonality(tx, ["date"]).collect()[0]
    assert (s.total_revenue, s.total_orders, s.avg_order_value) == (9.0, 2, 5.0)


def test_rfm_and_deviation(spark):
    rows = [("o1", "a", "A", dt.date(2024, 3, 1), 2.0, 2, 6.0), ("o1", "b", "A", dt.date(2024, 3, 1), 4.0, 2, 6.0),
            ("o2", "a", "A", dt.date(2024, 3, 3), 3.0, 1, 3.0), ("o3", "a", "B", dt.date(2024, 3, 3), 9.0, 1, 9.0),
            ("o4", "a", None, dt.date(2024, 3, 9), 1.0, 1, 1.0)]
    tx = _tx(spark, rows)
    got = [tuple(r) for r in rfm(tx).collect()]
    assert got == [("A", "CARD", 6, 2, 15.0, 5 / 3, 5.0)]
    dev = {(r.order_id, r.order_date): r for r in deviation(tx, k=None).collect()}
    r = dev[("o2", dt.date(2024, 3, 3))]
    assert r.avg_daily_aov == 6.0 and r.daily_aov_variance_percent == -50.0
    assert r.avg_overall_aov == 5.0


def test_profile_and_rules(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, 3.75, None), (4, None, "x")], "h long, m double, s string")
    d = {r.column_name: r for r in numeric_describe(df, scales={"m": 2}).collect()}
    assert (d["h"]["count"], d["h"].mean, d["h"].min, d["h"].q25, d["h"].q50, d["h"].q75, d["h"].max) == \
        (3, 7 / 3, 1.0, 1.5, 2.0, 3.0, 4.0)
    assert abs(d["h"].std - 1.5275252316519468) < 1e-15
    assert d["m"]["count"] == 2 and d["m"].mean == 3.125
    vc = {r.s: r["count"] for r in value_counts(df, "s", mode="sql").collect()}
    assert vc == {"x": 2, None: 0}
    vk = {r.s: r["count"] for r in value_counts(df, "s", mode="keepna").collect()}
    assert vk == {"x": 2, None: 1}
    rules = {r.rule: r.violations for r in check_rules(df, {"s_null": F.col("s").isNull(), "h_big": F.col("h") > 3}).collect()}
    assert rules == {"s_null": 1, "h_big": 1}


def test_golden_formulas(spark):
    """Formulas rebuilt from the reference's exported results (fixed values).

    Monthly totals (orders, revenue) -> growth; retention counts -> rate; pair and item counts -> rules.
    """
    import datetime as dt
    months = [(2024, 3, 172, 7050.20), (2024, 4, 156, 6720.56), (2024, 5, 212, 9063.42), (2024, 6, 176, 7758.76)]
    rows = [(f"{m}-{i}", dt.datetime(y, m, 1 + i % 28), revenue if i == 0 else 0.0)
            for y, m, orders, revenue in months for i in range(orders)]
    tx = spark.createDataFrame(rows, "order_id string, datetime timestamp_ntz, money double")
    got = growth(tx, period="month").collect()
    assert [(r.sales_month, r.monthly_orders, r.monthly_revenue) for r in got] == [(f"{y}-{m:02d}", o, r) for y, m, o, r in months]
    assert [(r.orders_growth_mom, r.revenue_growth_mom) for r in got] == [
        (None, None), (-0.093, -0.0468), (0.359, 0.3486), (-0.1698, -0.1439)]
    for retained, base, rate in [(16, 89, 17.98), (19, 69, 27.54), (23, 127, 18.11), (29, 110, 26.36)]:
        visits = [(f"c{i}", dt.date(2024, 4, 1)) for i in range(base)] + [(f"c{i}", dt.date(2024, 5, 3)) for i in range(retained)]
        one, = retention(spark.createDataFrame(visits, "card string, date date")).collect()
        assert (one.start_period_customers, one.retained_customers, one.monthly_retention_rate) == (base, retained, rate)
    n, na, nb, nab = 2984, 752, 732, 36   # orders, with Americano with Milk, with Latte, with both
    items = [(i, "Americano with Milk") for i in range(na)] + [(i, "Latte") for i in range(na - nab, na - nab + nb)]
    items += [(i, "Cocoa") for i in range(na + nb - nab, n)]
    one, = pair_rules(spark.createDataFrame(items, "order_id long, coffee_name string")).collect()
    assert (one.coffee_a, one.coffee_b, one.co_occurrence_count) == ("Americano with Milk", "Latte", nab)
    assert abs(one.Support_AB - 0.012064343163538873) < 1e-15
    assert abs(one.Confidence_A_to_B - 0.047872340425531915) < 1e-15
    assert abs(one.Confidence_B_to_A - 0.049180327868852458) < 1e-15
    assert abs(one.Lift - 0.19515172654342519) < 1e-12


def _pairs_by_hand(rows):
    baskets = {}
    for b, i in rows:
        if b is not None:
            baskets.setdefault(b, set()).update([i] if i is not None else [])
    out = {}
    for items in baskets.values():
        for x in items:
            for y in items:
                if x < y:
                    out[x, y] = out.get((x, y), 0) + 1
    return out


def test_pairs_of_a_large_catalogue_and_a_large_basket(spark):
    import random
    rng = random.Random(4)
    rows = [(b, f"item{rng.randrange(5000):04d}") for b in range(400) for _ in range(4)]
    rows += [(1000, f"item{i:04d}") for i in range(0, 5000, 25)] * 2        # one basket with 200 items, twice
    rows += [(None, "item0001"), (1001, None), (1002, None), (1002, "item0001")]
    tx = spark.createDataFrame(rows, "order_id long, coffee_name string")
    got = {(r.product_a, r.product_b): r.co_occurrence_count for r in pair_counts(tx, k=None).collect()}
    assert got == _pairs_by_hand(rows)
    one = pair_rules(tx, k=1).first()
    assert abs(one.Support_AB - one.co_occurrence_count / 403) < 1e-15
    plan = pair_counts(tx, k=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "mask" not in plan


def test_money_beyond_64_bits(spark):
    """Totals of 1e17 cents, an order total repeated on very many rows, and amounts with three decimals."""
    import datetime as dt
    rows = [("a", dt.datetime(2024, 3, 1), 4.0e15), ("b", dt.datetime(2024, 4, 1), 9.0e15), ("c", dt.datetime(2024, 4, 2), 1.0)]
    tx = spark.createDataFrame(rows, "order_id string, datetime timestamp_ntz, money double")
    got = growth(tx, period="month").collect()
    assert [(r.monthly_revenue, r.revenue_growth_mom) for r in got] == [(4.0e15, None), (9.0e15 + 1, 1.25)]
    big = spark.range(100_000).select(F.lit("o").alias("order_id"), F.lit(9.0e15).alias("total_value_of_order"),
                                      F.lit(100_000).alias("total_products_in_order"), F.lit(1.0).alias("money"),
                                      F.lit("x").alias("d"))
    one, = kpi_by(big, ["d"]).collect()
    assert one.total_revenue == 9.0e20 and one.average_order_value == 9.0e15 and one.units_per_transaction == 100_000
    fine = spark.createDataFrame([("x", 0.001), ("x", 0.004)], "coffee_name string, money double")
    one, = price_range(fine, ["coffee_name"], avg_name="m", money_scale=3).collect()
    assert one.m == 0.0  # 0.0025, to two places
    one, = kpi_by(fine.withColumn("order_id", F.lit("o")), ["coffee_name"], grain="order", money_scale=3).collect()
    assert one.total_revenue == 0.005


def test_deviation_keeps_rows_in_place(spark):
    """Without static broadcasts the day table is still sent to the rows: no exchange of rows by day."""
    import datetime as dt
    rows = [(f"o{i}", dt.datetime(2024, 3, 1 + i % 20), float(i)) for i in range(200)]
    tx = spark.createDataFrame(rows, "order_id string, datetime timestamp_ntz, total_value_of_order double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = deviation(tx)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


ORDERED = {  # query: columns in the order the original sorts by; a minus sign: descending
    "value_counts_hour": ["hour_of_day"], "value_counts_payment": ["cash_type"],
    "value_counts_product": ["-total_transactions"], "value_counts_daypart": ["Time_of_Day"],
    "daypart_hour_crosstab": ["hour_of_day", "Time_of_Day"], "value_counts_weekday": ["Weekday"],
    "value_counts_month": ["Month_name"], "value_counts_weekdaysort": ["Weekdaysort"],
    "value_counts_monthsort": ["Monthsort"], "hour_crosstab": ["hour", "hour_of_day"],
    "price_by_month_weekday": ["coffee_name", "Monthsort", "Weekdaysort"], "price_by_hour": ["coffee_name", "hour_of_day"],
    "price_by_daypart": ["coffee_name", "Time_of_Day", "-total_sales"], "price_by_payment": ["coffee_name", "cash_type"],
    "price_april_card": ["coffee_name", "cash_type", "Monthsort"], "orders_sessionized_debug": ["datetime"],
    "kpi_cube": ["Monthsort", "Weekdaysort", "hour_of_day"], "rfm": ["-M_lifetime_value"],
    "retention_month": ["period_month"], "retention_quarter": ["period_quarter"], "growth_month": ["sales_month"],
    "growth_quarter": ["sales_quarter"], "season_weekday_by_orders": ["-total_orders"],
    "season_weekday_by_revenue": ["-total_revenue"], "season_weekday_hour": ["Weekdaysort", "hour_of_day"],
    "season_one_weekday": ["hour_of_day"], "season_daypart": ["Time_of_Day"], "value_counts_money": ["money"],
    "value_counts_card": ["-count"], "notebook_counts_hour": ["hour_of_day"], "notebook_counts_product": ["-count"],
    "notebook_counts_daypart": ["-count"], "notebook_counts_weekday": ["-count"], "notebook_counts_month": ["-count"],
    "notebook_counts_weekdaysort": ["Weekdaysort"], "notebook_counts_monthsort": ["Monthsort"],
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_result_order(spark, name):
    from tillroll.plans.catalog import QUERIES
    rows = [r.asDict() for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()]
    wanted = rows
    for key in reversed(ORDERED[name]):
        wanted = sorted(wanted, key=lambda r: (r[key.lstrip("-")] is not None, r[key.lstrip("-")]), reverse=key[0] == "-")
    keys = [k.lstrip("-") for k in ORDERED[name]]
    assert len(rows) > 1 and [[r[k] for k in keys] for r in rows] == [[r[k] for k in keys] for r in wanted]


def test_quartiles_of_many_values(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    wide, few = rng.normal(0, 1e6, 3001).round(3), rng.integers(0, 4, 3001)
    df = spark.createDataFrame([(float(a), int(b), None) for a, b in zip(wide, few)], "wide double, few int, none double")
    got = {r.column_name: r for r in numeric_describe(df).collect()}
    for name, x in (("wide", wide), ("few", few)):
        assert np.allclose([got[name].q25, got[name].q50, got[name].q75], np.quantile(x, [0.25, 0.5, 0.75]), atol=1e-6)
    assert got["none"].q50 is None and got["none"]["count"] == 0
    one = spark.createDataFrame([(5.0,)], "x double")
    assert tuple(numeric_describe(one).first())[5:8] == (5.0, 5.0, 5.0)
    assert {r.column_name: r.distinct_count for r in distinct_counts(df).collect()} == {
        "wide": len(set(wide)), "few": 4, "none": 0}
    assert [tuple(r) for r in distinct_counts(df.limit(0)).collect()] == [("wide", 0), ("few", 0), ("none", 0)]
    plan = numeric_describe(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_own_mode_counts_with_nulls(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (None,), (None,), (1,)], "h int")
    assert [tuple(r) for r in value_counts(df, "h", mode="dropna").collect()] == [(1, 2), (3, 1)]
    assert [tuple(r) for r in value_counts(df, "h", mode="keepna", by_count=True).collect()] == [(None, 3), (1, 2), (3, 1)]


def test_profile_long_table(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, 3.75, None), (4, None, "x")], "h long, m double, s string")
    got = {(r.column_name, r.metric): r.value for r in profile(df, scales={"m": 2}).collect()}
    assert got[("s", "rows")] == 3 and got[("s", "nulls")] == 1 and got[("s", "null_pct")] == 33.33
    assert got[("s", "distinct")] == 1 and ("s", "mean") not in got
    assert got[("h", "mean")] == 7 / 3 and got[("h", "q50")] == 2.0 and got[("m", "max")] == 3.75
    assert abs(got[("h", "std")] - 1.5275252316519468) < 1e-15
    assert len(got) == 3 * 5 + 2 * 7


def test_rank_ties_broken_by_column_dimensions(spark):
    d = dt.date(2024, 3, 1)
    rows = [(f"o{i}", "a", "c", d, 1.0, 1, 1.0) for i in range(4)]
    tx = _tx(spark, rows).withColumn("datetime", F.col("datetime") + F.make_interval(hours=F.lit(0)))
    tx = tx.withColumn("h", F.when(F.col("order_id") < "o2", 9).otherwise(8))
    got = sorted((r.hour, r["rank"]) for r in seasonality(tx, [F.col("h").alias("hour")], rank_by="total_orders").collect())
    assert got == [(8, 1), (9, 2)]


def test_describe_bigint_uses_floating_std_unless_scaled(spark):
    df = spark.createDataFrame([(1_700_000_000_000_000 + i,) for i in range(5)], "us long")
    r = numeric_describe(df).collect()[0]
    assert abs(r["std"] - 1.5811388300841898) < 1e-3
    r2 = numeric_describe(df, scales={"us": 0}).collect()[0]
    assert r2["std"] == 1.5811388300841898


def test_retention_over_many_words_of_periods(spark):
    """Thirteen years of months: sets of three words, against plain sets of periods."""
    import random
    rng = random.Random(6)
    visits = [(f"c{rng.randrange(40)}", dt.date(2011 + m // 12, m % 12 + 1, rng.randint(1, 28)))
              for m in (rng.randrange(160) for _ in range(700))] + [(None, dt.date(2011, 1, 1)), ("c1", None)]
    visits += [("edge", dt.date(2011 + m // 12, m % 12 + 1, 5)) for m in (61, 62, 63, 64, 125, 126)]
    df = spark.createDataFrame(visits, "card string, date date")
    active = {}
    for card, day in visits:
        if card and day:
            active.setdefault(day.year * 12 + day.month - 1, set()).add(card)
    for adjacent in (False, True):
        want, before, periods = [], set(), sorted(active)
        for i, p in enumerate(periods):
            base = before if not adjacent else active.get(p - 1, set())
            if i:
                kept, start = len(active[p] & base), len(active[periods[i - 1]])
                want.append((f"{p // 12}-{p % 12 + 1:02d}", len(active[p]), start, kept))
            before |= active[p]
        assert [tuple(r)[:4] for r in retention(df, adjacent=adjacent).collect()] == want
    assert retention(df.limit(0)).count() == 0
    plan = retention(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "hashpartitioning(__c" in plan


def test_dependency_pairs(spark):
    from tillroll.operators.quality import dependency_pairs
    rows = [("a", 1, 0.0), ("a", 1, -0.0), ("a", 2, 0.0), ("b", 3, 1.0), (None, None, None), (None, 4, None)]
    df = spark.createDataFrame(rows, "x string, y int, z double")
    got = {(r.determinant, r.dependent): tuple(r)[2:] for r in dependency_pairs(df, ["x", "y", "z"]).collect()}
    assert len(got) == 6
    assert got["x", "y"] == (3, 2, 2, 33.33, False) and got["y", "x"] == (5, 0, 0, 0.0, True)
    assert got["x", "z"] == (3, 0, 0, 0.0, True)
    one = dependency_pairs(df, ["x"], ["z"]).collect()
    assert [(r.determinant, r.dependent, r.holds) for r in one] == [("x", "z", True)]
    assert dependency_pairs(df.limit(0), ["x", "y"]).select("rows_to_remove", "holds").distinct().collect() == [(0, True)]
