"""Customer value (RFM, O13) and retention by period (O14)."""

from __future__ import annotations

import datetime as _dt

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.keys import period_key, period_months
from tillroll.functions.money import MONEY_SCALE, cents_to_amount, mean_amount, round_ratio, to_cents

WORD = 63  # periods of a word: all bits of a long but its sign


def rfm(
    tx: DataFrame,
    customer: str = "card",
    ts: str = "datetime",
    order_id: str = "order_id",
    value_col: str = "total_value_of_order",
    items_col: str = "total_products_in_order",
    money: str = "money",
    min_orders: int = 2,
    grain: str = "item",
    customer_type: str = "CARD",
    customer_name: str = "card",
    money_scale: int = MONEY_SCALE,
) -> DataFrame:
    """Recency, frequency, monetary value per identified customer, largest value first.

    Recency = days from the customer's last purchase day to the last day of
    the whole table (all customers, cash included; a one-row scalar subquery).
    Frequency = distinct orders; only customers with at least ``min_orders``.
    ``grain="item"`` (reference): value and averages over item rows of the
    repeated order totals. ``grain="order"``: value = sum of item prices,
    averages per order.
    """
    # One aggregation over all rows, unidentified customers (NULL) included. The
    # last day of the table is a scalar subquery over it; column pruning leaves
    # that one its date column only, so it reads that column a second time.
    per = tx.groupBy(customer).agg(
        F.max(F.to_date(ts)).alias("__last"),
        F.countDistinct(order_id).alias("F_total_orders"),
        F.sum(to_cents(value_col, money_scale)).alias("__vc"),
        F.count(value_col).alias("__vn"),
        F.sum(items_col).alias("__items"),
        F.count(items_col).alias("__in"),
        F.sum(to_cents(money, money_scale)).alias("__mc"),
        F.count(F.lit(1)).alias("__rows"),
    )
    last_day = per.agg(F.max("__last")).scalar()
    per = per.filter(F.col(customer).isNotNull() & (F.col("F_total_orders") >= min_orders))
    if grain == "item":
        m = F.col("__vc")
        upt = F.col("__items") / F.col("__in")
        aov = mean_amount(F.col("__vc"), F.col("__vn"), money_scale)
    elif grain == "order":
        m = F.col("__mc")
        upt = F.col("__rows") / F.col("F_total_orders")
        aov = mean_amount(F.col("__mc"), F.col("F_total_orders"), money_scale)
    else:
        raise ValueError(f"grain must be 'item' or 'order', not {grain!r}")
    return per.select(
        F.col(customer).alias(customer_name),
        F.lit(customer_type).alias("customer_type"),
        F.datediff(last_day, F.col("__last")).cast("long").alias("R_recency_days_since_last_purchase"),
        "F_total_orders",
        cents_to_amount(m, money_scale).alias("M_lifetime_value"),
        upt.alias("avg_products_per_order_per_customer"),
        aov.alias("avg_order_value_per_customer"),
    ).orderBy(F.desc("M_lifetime_value"))


def retention(
    tx: DataFrame,
    customer: str = "card",
    date: str = "date",
    period: str = "month",
    cutoff: str | _dt.date | None = None,
    adjacent: bool = False,
) -> DataFrame:
    """Customers per period, the previous period's base, retained customers and rate.

    A customer counts as retained in a period when active in it and in *any*
    earlier period (the reference's reading); ``adjacent=True`` requires the
    immediately preceding period. ``cutoff`` keeps days before that date. The
    first period (no base) is dropped; rate = round(retained * 100 / base, 2).
    The base is the previous period present in the data (a period with no
    active customers has no row), as in the original.
    A customer becomes one set of bits, one for each period, in words of 63;
    the span of dates is read first to know how many words (one for five
    years of months). Rows collapse to such sets before the one exchange by
    customer, and both readings are bit operations on them.
    """
    names = {"month": ("period_month", "monthly_retention_rate"),
             "quarter": ("period_quarter", "quarterly_retention_rate")}[period]
    rows = tx.filter(F.col(customer).isNotNull())
    if cutoff is not None:
        rows = rows.filter(F.col(date) < F.lit(str(cutoff)).cast("date"))
    ends = rows.agg(F.min(date).alias("a"), F.max(date).alias("b")).first()
    step = period_months(period)
    first, last = ((d.year * 12 + d.month - 1) // step if d else 0 for d in (ends["a"], ends["b"]))
    words = (last - first) // WORD + 1
    number = F.floor((F.year(date) * 12 + F.month(date) - 1) / step).cast("int") - first
    bit = F.expr(f"shiftleft(1L, cast(__n % {WORD} AS int))")
    sets = (rows.where(F.col(date).isNotNull()).select(F.col(customer).alias("__c"), number.alias("__n"))
                .groupBy("__c").agg(*(F.coalesce(F.bit_or(F.when(F.floor(F.col("__n") / WORD) == w, bit)), F.lit(0).cast("bigint"))
                                      .alias(f"__w{w}") for w in range(words))))
    active = [F.col(f"__w{w}") for w in range(words)]
    if adjacent:  # active in the period before: the bits one place up, with the last bit of the word before
        full = F.lit((1 << WORD) - 1).cast("bigint")
        carry = [F.lit(0).cast("bigint"), *(F.shiftright(a, WORD - 1) for a in active[:-1])]
        kept = [a.bitwiseAND(F.shiftleft(a, 1).bitwiseAND(full).bitwiseOR(c)) for a, c in zip(active, carry)]
    else:  # all but the lowest bit of the first word that has any
        kept = [F.when(reduce(or_, (b != 0 for b in active[:w]), F.lit(False)), a)
                .when(a != 0, a.bitwiseAND(a - 1)).otherwise(F.lit(0).cast("bigint")) for w, a in enumerate(active)]
    # one row for each period of a customer, counted before it is exchanged
    places = [F.struct(F.lit(w * WORD).alias("at"), a.alias("active"), k.alias("kept")) for w, (a, k) in enumerate(zip(active, kept))]
    bits = sets.select(F.inline(F.array(*places))).where("active <> 0").select(
        "at", "active", "kept", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("k")).where("getbit(active, k) = 1")
    month = (F.col("at") + F.col("k") + first) * step
    per = (bits.groupBy((F.col("at") + F.col("k")).alias("__p"), F.make_date(
                    F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1)).alias("__start"))
               .agg(F.count(F.lit(1)).alias("end_period_customers"), F.sum(F.expr("getbit(kept, k)").cast("bigint")).alias("retained_customers")))
    per = per.select(F.col("__start").alias("__p"), "end_period_customers", "retained_customers")
    start = F.lag("end_period_customers").over(Window.orderBy("__p"))
    out = per.select(
        period_key(F.col("__p"), period).alias(names[0]),
        "end_period_customers",
        start.alias("start_period_customers"),
        "retained_customers",
    )
    return (out.filter(F.col("start_period_customers").isNotNull())
               .withColumn(names[1], round_ratio(F.col("retained_customers") * 100, F.col("start_period_customers"), 2))
               .orderBy(names[0]))
