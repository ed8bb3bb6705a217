"""Growth by period (O15) and deviation of orders from the daily mean (O17)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.keys import period_key
from tillroll.functions.money import MONEY_SCALE, cents_to_amount, round_ratio, to_cents

_GROWTH_NAMES = {
    "month": ("sales_month", "monthly_orders", "monthly_revenue", "orders_growth_mom", "revenue_growth_mom"),
    "quarter": ("sales_quarter", "quarterly_orders", "quarterly_revenue", "orders_growth_qoq", "revenue_growth_qoq"),
}


def before_cutoff(df: DataFrame, ts: str, cutoff: str | _dt.date | None) -> DataFrame:
    """Rows whose day is before ``cutoff`` (a date), written as a range on the raw
    timestamp so that a Parquet scan receives it as a pushed filter."""
    if cutoff is None:
        return df
    bound = F.lit(str(cutoff)).cast("date").cast(df.schema[ts].dataType)
    return df.filter(F.col(ts) < bound)


def growth(
    tx: DataFrame,
    period: str = "month",
    revenue: str = "money",
    cutoff: str | _dt.date | None = None,
    drop_first: bool = False,
    ts: str = "datetime",
    order_id: str = "order_id",
    money_scale: int = MONEY_SCALE,
) -> DataFrame:
    """Distinct orders and revenue per period, with relative change to the previous period, in order of period.

    ``revenue="money"`` sums item prices; ``revenue="total_value_of_order"`` sums
    the order total repeated on every item row (the reference's quarterly form,
    which over-weights multi-item orders). Growth is rounded to 4 places; the
    first period has NULL growth and is removed by ``drop_first``. The
    previous period is the previous one present in the data, as in the
    original. The change is computed after aggregation, over one row per
    period, so its unpartitioned window is tiny.
    """
    pname, oname, rname, ogname, rgname = _GROWTH_NAMES[period]
    rows = before_cutoff(tx, ts, cutoff)
    per = rows.groupBy(period_key(F.to_date(ts), period).alias(pname)).agg(
        F.countDistinct(order_id).alias(oname),
        F.sum(to_cents(revenue, money_scale)).alias("__cents"),
    )
    w = Window.orderBy(pname)
    prev_o = F.lag(oname).over(w)
    prev_c = F.lag("__cents").over(w)
    out = per.select(
        pname, oname,
        cents_to_amount(F.col("__cents"), money_scale).alias(rname),
        round_ratio(F.col(oname) - prev_o, prev_o, 4).alias(ogname),
        round_ratio(F.col("__cents") - prev_c, prev_c, 4).alias(rgname),
        prev_o.alias("__prev"),
    )
    if drop_first:
        out = out.filter(F.col("__prev").isNotNull())
    return out.orderBy(pname).drop("__prev")


def deviation(
    tx: DataFrame,
    value: str = "total_value_of_order",
    ts: str = "datetime",
    order_id: str = "order_id",
    k: int | None = 100,
    grain: str = "item",
    extra_cols: tuple[str, ...] = (),
    with_overall: bool = True,
    money_scale: int = MONEY_SCALE,
) -> DataFrame:
    """Percent deviation of each order's value from the mean of its day, largest first.

    ``grain="item"`` (reference): one row per item row, means over item rows, so
    multi-item orders repeat and weigh more. ``grain="order"``: one row per
    order, dated by its first item. Means are exact (cent sums / counts) and
    rounded to 2 places; the deviation uses the unrounded daily mean.

    The daily mean is a per-day aggregate joined back on the day. It is broadcast:
    its size is bounded by the number of calendar days, whatever the rows, which
    therefore stay where they are. The overall mean is a window over that per-day table,
    carried by the same join. No window over the rows, no single-partition
    exchange of the rows, one pass over them.
    """
    if grain == "item":
        rows = tx.select(order_id, F.to_date(ts).alias("order_date"), *extra_cols, value)
    elif grain == "order":
        rows = (tx.groupBy(order_id)
                  .agg(F.to_date(F.min(ts)).alias("order_date"), F.max(value).alias(value),
                       *[F.min(c).alias(c) for c in extra_cols])
                  .select(order_id, "order_date", *extra_cols, value))
    else:
        raise ValueError(f"grain must be 'item' or 'order', not {grain!r}")
    rows = rows.withColumn("__c", to_cents(value, money_scale))
    daily = rows.groupBy("order_date").agg(F.sum("__c").alias("__ds"), F.count("__c").alias("__dn"))
    cols = [order_id, "order_date", *extra_cols, value]
    if with_overall:
        # the per-day table has one row per calendar day, so totals over it are a
        # tiny unpartitioned window, carried to the rows by the same join
        everything = Window.partitionBy()
        daily = (daily.withColumn("__os", F.sum("__ds").over(everything))
                      .withColumn("__on", F.sum("__dn").over(everything)))
        cols.append(round_ratio(F.col("__os"), F.col("__on") * 10**money_scale, 2).alias("avg_overall_aov"))
    j = rows.join(F.broadcast(daily), on="order_date", how="inner")
    out = j.select(
        *cols,
        round_ratio(F.col("__ds"), F.col("__dn") * 10**money_scale, 2).alias("avg_daily_aov"),
        round_ratio((F.col("__c") * F.col("__dn") - F.col("__ds")) * 100, F.col("__ds"), 2).alias("daily_aov_variance_percent"),
    )
    if k is None:
        return out
    ties = [F.asc(c) for c in (order_id, "order_date", *extra_cols)]
    return out.orderBy(F.desc("daily_aov_variance_percent"), *ties).limit(k)
