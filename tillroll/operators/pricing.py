"""Price consistency checks (O7) and a product's sales history (O8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import MONEY_SCALE, round_ratio, to_cents


def price_range(
    df: DataFrame,
    dims: list[str | Column],
    price: str = "money",
    avg_name: str | None = None,
    having: Column | None = None,
    order_by: list[str | Column] | None = None,
    money_scale: int = MONEY_SCALE,
) -> DataFrame:
    """Item count, lowest and highest price (and, with ``avg_name``, the mean
    price rounded to 2 places) per group. ``having`` filters groups; a condition
    on group keys only is pushed below the aggregate by the optimizer.
    The groups come in order of ``order_by`` (default: of the dimensions)."""
    aggs = [F.count(F.lit(1)).alias("total_sales"), F.min(price).alias("min_price"), F.max(price).alias("max_price")]
    if avg_name:
        aggs.append(round_ratio(F.sum(to_cents(price, money_scale)), F.count(price) * 10**money_scale, 2).alias(avg_name))
    out = df.groupBy(*dims).agg(*aggs)
    out = out if having is None else out.filter(having)
    return out.orderBy(*(order_by or out.columns[:len(dims)]))


def product_history(df: DataFrame, product: str, product_col: str = "coffee_name", ts: str = "datetime") -> DataFrame:
    """All sales of one product in time order."""
    return df.filter(F.col(product_col) == product).orderBy(ts)
