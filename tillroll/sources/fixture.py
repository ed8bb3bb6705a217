"""A ``sales`` table derived from the ``events`` table of the test data.

Every test and registered query reads real tables; this view turns the event
stream into coffee-shop sales with the same columns and traps as the raw data:
a 13-month span with a partial last month, cash rows without a card, items
grouped into orders by 300-second gaps (including gaps of exactly 300 s,
299.999999 s and 0 s), a repeated product inside one order, and a few rows whose
stored hour is wrong. One pass over ``events``: the 1-3 items of each event come
from ``explode`` rather than a union of three scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.money import small_floor_div

# The product that follows each event type for the second item.
NEXT_PRODUCT = {"view": "click", "click": "purchase", "purchase": "signup", "signup": "error", "error": "view"}
# Weekday labels by ISO weekday 1..7 (Monday first), Polish abbreviations.
WEEKDAY_LABELS = ["pon.", "wt.", "śr.", "czw.", "pt.", "sob.", "niedz."]
# Month labels by month number 1..12.
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _next_product(col: Column) -> Column:
    expr = None
    for src, dst in NEXT_PRODUCT.items():
        expr = (F.when(col == src, F.lit(dst)) if expr is None else expr.when(col == src, F.lit(dst)))
    return expr


def _second_item_offset_us(m: Column) -> Column:
    return (F.when(m <= 7, F.lit(97_250_000))
            .when(m == 8, F.lit(300_000_000))
            .when(m == 9, F.lit(299_999_999))
            .otherwise(F.lit(0)))


def _digits4(n: Column) -> Column:
    return F.lpad(n.cast("string"), 4, "0")


def sales_from_events(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    m = F.pmod(e, F.lit(50))
    base = events.select(
        e.alias("_e"),
        m.alias("_m"),
        F.col("user_id").alias("_user"),
        F.col("event_type").alias("_type"),
        F.round(F.col("value") * 100).cast("long").alias("_c0"),
        F.timestamp_add("DAY", F.lit(60) + F.lit(12) * (F.dayofmonth("ts") - 1), F.col("ts")).alias("_dt"),
        # item index 0..n-1: a second item when m <= 10, a third when m <= 2
        F.explode(F.sequence(F.lit(0), (m <= 10).cast("int") + (m <= 2).cast("int"))).alias("_k"),
    )
    k = F.col("_k")
    offset = F.when(k == 0, F.lit(0)).when(k == 1, _second_item_offset_us(F.col("_m"))).otherwise(F.lit(200_000_000))
    items = base.select(
        "_e", "_user",
        F.when(k == 1, _next_product(F.col("_type"))).otherwise(F.col("_type")).alias("_product"),
        (F.col("_c0") + F.lit(100) * k).alias("_cents"),
        F.timestamp_add("MICROSECOND", offset, F.col("_dt")).alias("_ts"),
    )
    ts = F.col("_ts")
    cash = F.pmod(F.col("_e"), F.lit(40)) == 0
    card_no = F.col("_user") * 20 + F.pmod(F.col("_e") * 7919, F.lit(20))
    cents = F.col("_cents")
    whole = small_floor_div(cents, 100)
    money_card = F.concat(F.lit("R"), whole.cast("string"), F.lit(","), F.lpad((cents - whole * 100).cast("string"), 2, "0"))
    money_cash = F.concat(F.lit("R"), small_floor_div(cents + 99, 100).cast("string"))
    hour = F.hour(ts)
    iso_wd = (F.weekday(F.to_date(ts)) + 1).cast("long")
    month = F.month(F.to_date(ts)).cast("long")
    return items.select(
        F.to_date(ts).alias("date"),
        ts.alias("datetime"),
        F.when(F.pmod(F.col("_e"), F.lit(997)) == 0, F.pmod(hour + 1, F.lit(24))).otherwise(hour).cast("long").alias("hour_of_day"),
        F.when(cash, F.lit("cash")).otherwise(F.lit("card")).alias("cash_type"),
        F.when(~cash, F.concat(F.lit("ANON-"), _digits4(small_floor_div(card_no, 10**8)), F.lit("-"),
                               _digits4(F.pmod(small_floor_div(card_no, 10**4), F.lit(10**4))), F.lit("-"),
                               _digits4(F.pmod(card_no, F.lit(10**4))))).alias("card"),
        F.when(cash, money_cash).otherwise(money_card).alias("money"),
        F.col("_product").alias("coffee_name"),
        F.when(hour < 12, F.lit("Morning")).when(hour < 17, F.lit("Afternoon")).otherwise(F.lit("Night")).alias("Time_of_Day"),
        F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_LABELS]), iso_wd.cast("int")).alias("Weekday"),
        F.element_at(F.array(*[F.lit(x) for x in MONTH_LABELS]), month.cast("int")).alias("Month_name"),
        iso_wd.alias("Weekdaysort"),
        month.alias("Monthsort"),
    )


def load_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_from_events(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"))
