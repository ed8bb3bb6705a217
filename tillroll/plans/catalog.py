"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per report.

Every query reads the given tables (the ``sales`` view is derived from
``events``; the generic basket/customer reports read ``lineitem``, ``part`` and
``orders``) and runs over them whole. Parameters that the reference fixed in
its text (a month, a weekday, a product, cutoff dates) are stated here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.clock import is_ntz, time_of_day_text
from tillroll.operators.basket import pair_counts, pair_rules
from tillroll.operators.clean import clean_sales
from tillroll.operators.customers import retention, rfm
from tillroll.operators.kpi import kpi_by, seasonality
from tillroll.operators.orders import HELPERS, sessionize_orders
from tillroll.operators.pricing import price_range, product_history
from tillroll.operators.quality import (
    check_rules, crosstab, dependency_pairs, distinct_counts, extremes, functional_dependency, non_null_counts,
    null_audit, null_percent, numeric_describe, profile, rule_rows, value_counts,
)
from tillroll.operators.trends import deviation, growth
from tillroll.sources.fixture import load_sales

# Parameters of the reference's reports (fixed values).
GAP_SECONDS = 300
MONTH_CUTOFF = "2025-03-01"          # first day of the partial last month
CHECK_HOUR = 6                        # the suspicious opening hour
APRIL = 4
HISTORY_PRODUCT = "purchase"          # a product of the test data
BUSY_WEEKDAY = "pon."
# decimals the numeric sales columns are exact to (exact mean and std)
EXACT_SCALES = {"Weekdaysort": 0, "Monthsort": 0, "hour_of_day": 0, "money": 2}
LABELS = ["Weekday", "Weekdaysort", "Month_name", "Monthsort", "Time_of_Day", "hour_of_day"]
KPI_DIMS = ["Month_name", "Monthsort", "Weekday", "Weekdaysort", "Time_of_Day", "hour_of_day", "cash_type"]
KPI_ORDER = ["Monthsort", "Weekdaysort", "hour_of_day", "cash_type", "Month_name", "Weekday", "Time_of_Day"]


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_sales(spark, sf_dir)


def sales_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_sales(sales(spark, sf_dir))


def transactions(spark: SparkSession, sf_dir: str, keep_helpers: bool = False) -> DataFrame:
    tie = ["coffee_name", "money"] if keep_helpers else None
    return sessionize_orders(sales_clean(spark, sf_dir), gap_seconds=GAP_SECONDS, keep_helpers=keep_helpers, tie_break=tie)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- sources ----------------------------------------------------------------

def _brand_lines(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = _table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey, "inner")


def _orders_by_day(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").withColumn("o_day", F.to_date("o_orderdate"))


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sales": sales,
    "clean": sales_clean,
    "tx": transactions,
    "tx_debug": lambda spark, d: transactions(spark, d, keep_helpers=True),
    "brand_lines": _brand_lines,
    "orders": _orders_by_day,
}


# ---- reports: each is a function of its source table --------------------------

def _time_text(s: DataFrame) -> Column:
    return time_of_day_text(F.col("datetime"), is_ntz(s, "datetime"))


def _hour() -> Column:
    return F.hour("datetime").cast("long").alias("hour_of_day")


def _vc(column: str, mode: str = "sql", count_name: str = "total_transactions", by_count: bool = False):
    return lambda df: value_counts(df, column, mode=mode, count_name=count_name, by_count=by_count)


def _price(dims, avg_name=None, having=None):
    return lambda df: price_range(df, dims, avg_name=avg_name, having=having() if having else None)


def _hour_mismatch(df: DataFrame) -> DataFrame:
    extracted = F.hour("datetime").cast("long")
    return rule_rows(df, F.col("hour_of_day") != extracted, ["datetime", "hour_of_day", extracted.alias("extracted_hour")])


REPORTS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    # preparation and profiling (raw sales)
    "date_extremes_first": ("sales", lambda s: extremes(s, "date", 10)),
    "date_extremes_last": ("sales", lambda s: extremes(s, "date", 10, desc=True)),
    "time_extremes_first": ("sales", lambda s: extremes(s, _time_text(s), 10, name="order_time")),
    "time_extremes_last": ("sales", lambda s: extremes(s, _time_text(s), 10, desc=True, name="order_time")),
    "null_audit": ("sales", null_audit),
    "null_pct": ("sales", null_percent),
    "rule_card_null": ("sales", lambda s: rule_rows(s, F.col("card").isNull())),
    "rule_card_cash": ("sales", lambda s: check_rules(
        s, {"card_null_not_cash": F.col("card").isNull() & (F.col("cash_type") != "cash")})),
    "rule_hour_value": ("sales", lambda s: rule_rows(s, F.col("hour_of_day") == CHECK_HOUR)),
    "value_counts_hour": ("sales", _vc("hour_of_day")),
    "value_counts_payment": ("sales", _vc("cash_type")),
    "value_counts_product": ("sales", _vc("coffee_name", by_count=True)),
    "value_counts_daypart": ("sales", _vc("Time_of_Day")),
    "value_counts_weekday": ("sales", _vc("Weekday")),
    "value_counts_month": ("sales", _vc("Month_name")),
    "value_counts_weekdaysort": ("sales", _vc("Weekdaysort")),
    "value_counts_monthsort": ("sales", _vc("Monthsort")),
    "value_counts_card": ("sales", _vc("card", mode="keepna", count_name="count", by_count=True)),
    # the notebook's own modes: sorted by value without NULLs, or most frequent first with NULLs counted
    "notebook_counts_hour": ("sales", _vc("hour_of_day", mode="dropna", count_name="count")),
    "notebook_counts_product": ("sales", _vc("coffee_name", mode="keepna", count_name="count", by_count=True)),
    "notebook_counts_daypart": ("sales", _vc("Time_of_Day", mode="keepna", count_name="count", by_count=True)),
    "notebook_counts_weekday": ("sales", _vc("Weekday", mode="keepna", count_name="count", by_count=True)),
    "notebook_counts_weekdaysort": ("sales", _vc("Weekdaysort", mode="dropna", count_name="count")),
    "notebook_counts_month": ("sales", _vc("Month_name", mode="keepna", count_name="count", by_count=True)),
    "notebook_counts_monthsort": ("sales", _vc("Monthsort", mode="dropna", count_name="count")),
    "value_counts_money": ("clean", _vc("money", mode="dropna", count_name="count")),
    "daypart_hour_crosstab": ("sales", lambda s: crosstab(s, "Time_of_Day", "hour_of_day", count_name="total_count",
                                                          order_by=["hour_of_day", "Time_of_Day"])),
    "hour_crosstab": ("sales", lambda s: crosstab(s, F.hour("datetime").cast("long").alias("hour"), "hour_of_day",
                                                  count_of="hour_of_day", count_name="row_count")),
    "fd_weekday": ("sales", lambda s: functional_dependency(s, "Weekday", "Weekdaysort")),
    "fd_month": ("sales", lambda s: functional_dependency(s, "Month_name", "Monthsort")),
    "fd_pairs": ("sales", lambda s: dependency_pairs(s, LABELS)),
    "rule_hour_mismatch": ("sales", _hour_mismatch),
    "sales_clean": ("clean", lambda c: c),
    "rule_hour_mismatch_after_clean": ("clean", lambda c: check_rules(
        c, {"hour_mismatch": F.col("hour_of_day") != F.hour("datetime")})),
    "non_null_counts": ("sales", non_null_counts),
    "numeric_describe": ("clean", lambda c: numeric_describe(c, scales=EXACT_SCALES)),
    "distinct_counts": ("sales", distinct_counts),
    # all of the above in one long table, from one pass (the clean table: numeric money)
    "profile": ("clean", lambda c: profile(c, scales=EXACT_SCALES)),
    # price consistency (clean sales)
    "price_by_month_weekday": ("clean", _price(["coffee_name", "Monthsort", "Weekdaysort"])),
    "price_by_hour": ("clean", _price(["coffee_name", "hour_of_day"])),
    "price_by_daypart": ("clean", _price(["coffee_name", "Time_of_Day"], avg_name="avg_time_of_day_price")),
    "price_by_payment": ("clean", _price(["coffee_name", "cash_type"], avg_name="avg_payment_price")),
    "price_april_card": ("clean", lambda c: price_range(
        c, ["coffee_name", "cash_type", "Monthsort"], avg_name="avg_payment_price",
        having=(F.col("Monthsort") == APRIL) & (F.col("cash_type") == "card"))),
    "product_history": ("clean", lambda c: product_history(c, HISTORY_PRODUCT)),
    # orders and reports on them
    "orders_sessionized_debug": ("tx_debug", lambda t: t.orderBy("datetime")),
    "sales_transactions": ("tx", lambda t: t),
    "kpi_cube": ("tx", lambda t: kpi_by(t, KPI_DIMS, order_by=KPI_ORDER)),
    "kpi_cube_order_grain": ("tx", lambda t: kpi_by(t, KPI_DIMS, grain="order", order_by=KPI_ORDER)),
    "top_pairs": ("tx", lambda t: pair_counts(t, k=10)),
    "pair_rules": ("tx", lambda t: pair_rules(t, k=10)),
    "rfm": ("tx", rfm),
    "rfm_order_grain": ("tx", lambda t: rfm(t, grain="order")),
    "retention_month": ("tx", lambda t: retention(t, period="month", cutoff=MONTH_CUTOFF)),
    "retention_month_adjacent": ("tx", lambda t: retention(t, period="month", cutoff=MONTH_CUTOFF, adjacent=True)),
    # The reference's quarter cutoff compares '2025-Q' < '2025-Q1', true for every row: nothing is cut.
    "retention_quarter": ("tx", lambda t: retention(t, period="quarter", cutoff=None)),
    "growth_month": ("tx", lambda t: growth(t, period="month", revenue="money")),
    "growth_quarter": ("tx", lambda t: growth(t, period="quarter", revenue="total_value_of_order",
                                              cutoff=MONTH_CUTOFF, drop_first=True)),
    "growth_quarter_order_grain": ("tx", lambda t: growth(t, period="quarter", revenue="money",
                                                          cutoff=MONTH_CUTOFF, drop_first=True)),
    "season_weekday": ("tx", lambda t: seasonality(t, ["Weekday"], sort_key="Weekdaysort")),
    "season_weekday_by_orders": ("tx", lambda t: seasonality(t, ["Weekday"], sort_key="Weekdaysort",
                                                             rank_by="total_orders")),
    "season_weekday_by_revenue": ("tx", lambda t: seasonality(t, ["Weekday"], sort_key="Weekdaysort",
                                                              rank_by="total_revenue")),
    "season_weekday_hour": ("tx", lambda t: seasonality(t, ["Weekday", "Weekdaysort", _hour()],
                                                       order_by=["Weekdaysort", "hour_of_day", "Weekday"])),
    "season_one_weekday": ("tx", lambda t: seasonality(t, [_hour()], where=F.col("Weekday") == BUSY_WEEKDAY)),
    "season_daypart": ("tx", lambda t: seasonality(t, ["Time_of_Day"])),
    "daily_deviation": ("tx", lambda t: deviation(t, k=100)),
    "daily_deviation_order_grain": ("tx", lambda t: deviation(t, k=100, grain="order")),
    # the layout of the exported deviation file: with card and product, without the overall mean
    "daily_deviation_export": ("tx", lambda t: deviation(t, k=100, extra_cols=("card", "coffee_name"),
                                                         with_overall=False)),
    # the same operators on the star-schema tables
    "brand_pairs": ("brand_lines", lambda b: pair_counts(b, basket="l_orderkey", item="p_brand", k=10,
                                                         names=("brand_a", "brand_b"))),
    "brand_rules": ("brand_lines", lambda b: pair_rules(b, basket="l_orderkey", item="p_brand", k=10,
                                                        names=("brand_a", "brand_b"))),
    "customer_retention_month": ("orders", lambda o: retention(o, customer="o_custkey", date="o_day", period="month")),
    "order_growth_month": ("orders", lambda o: growth(o, period="month", revenue="o_totalprice", ts="o_orderdate",
                                                      order_id="o_orderkey")),
}


def _bind(source: str, report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(SOURCES[source](spark, sf_dir))
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _bind(src, fn) for name, (src, fn) in REPORTS.items()}

__all__ = ["HELPERS", "QUERIES", "REPORTS", "SOURCES", "sales", "sales_clean", "transactions"]
