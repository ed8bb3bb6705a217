"""Order KPIs by any dimensions (O10) and seasonality reports (O16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.money import MONEY_SCALE, cents_to_amount, mean_amount, round_ratio, to_cents


def kpi_by(
    tx: DataFrame,
    dims: list[str | Column],
    grain: str = "item",
    order_id: str = "order_id",
    value_col: str = "total_value_of_order",
    items_col: str = "total_products_in_order",
    money: str = "money",
    order_by: list[str | Column] | None = None,
    money_scale: int = MONEY_SCALE,
) -> DataFrame:
    """Orders, items, revenue, average order value (AOV) and units per order (UPT).

    ``grain="item"`` follows the reference: revenue, AOV and UPT aggregate the
    order totals repeated on every item row. ``grain="order"`` gives the
    corrected figures: revenue = sum of item prices, AOV = revenue / orders,
    UPT = items / orders. Orders are counted distinct per group, so an order
    that straddles two groups counts in both. ``order_by`` orders the
    aggregated rows (default: by the dimensions).
    """
    n = F.count(F.lit(1))
    orders = F.countDistinct(order_id)
    if grain == "item":
        vc = F.sum(to_cents(value_col, money_scale))
        aggs = [
            orders.alias("total_orders"), n.alias("total_items_sold"),
            cents_to_amount(vc, money_scale).alias("total_revenue"),
            round_ratio(vc, F.count(value_col) * 10**money_scale, 2).alias("average_order_value"),
            round_ratio(F.sum(items_col), F.count(items_col), 2).alias("units_per_transaction"),
        ]
    elif grain == "order":
        mc = F.sum(to_cents(money, money_scale))
        aggs = [
            orders.alias("total_orders"), n.alias("total_items_sold"),
            cents_to_amount(mc, money_scale).alias("total_revenue"),
            round_ratio(mc, orders * 10**money_scale, 2).alias("average_order_value"),
            round_ratio(n, orders, 2).alias("units_per_transaction"),
        ]
    else:
        raise ValueError(f"grain must be 'item' or 'order', not {grain!r}")
    out = tx.groupBy(*dims).agg(*aggs)
    return out.orderBy(*(order_by or out.columns[:len(dims)]))


def seasonality(
    tx: DataFrame,
    dims: list[str | Column],
    sort_key: str | None = None,
    where: Column | None = None,
    rank_by: str | None = None,
    order_by: list[str | Column] | None = None,
    order_id: str = "order_id",
    value_col: str = "total_value_of_order",
    money: str = "money",
    money_scale: int = MONEY_SCALE,
) -> DataFrame:
    """Revenue (sum of item prices), distinct orders and mean order value (over
    item rows) by calendar dimensions.

    ``sort_key`` is grouped on but not returned (a label with a hidden sort
    order). The result is ordered by ``rank_by`` (``total_orders`` or
    ``total_revenue``) descending, ties by the dimension values, with ``rank``
    telling the place; else by ``order_by``, ``sort_key`` or the dimensions.
    Ranks are computed over the aggregated rows only.
    """
    rows = tx if where is None else tx.filter(where)
    keys = list(dims) + ([sort_key] if sort_key else [])
    out = rows.groupBy(*keys).agg(
        cents_to_amount(F.sum(to_cents(money, money_scale)), money_scale).alias("total_revenue"),
        F.countDistinct(order_id).alias("total_orders"),
        mean_amount(F.sum(to_cents(value_col, money_scale)), F.count(value_col), money_scale).alias("avg_order_value"),
    )
    # group keys come first in the aggregate's output, Column dimensions included
    names = out.columns[:len(dims)]
    if rank_by:
        place = [F.desc(rank_by), *(F.asc(c) for c in names)]
        out = out.withColumn("rank", F.row_number().over(Window.orderBy(*place)).cast("long")).orderBy("rank")
    else:
        out = out.orderBy(*(order_by or ([sort_key] if sort_key else names)))
    return out.drop(sort_key) if sort_key else out
