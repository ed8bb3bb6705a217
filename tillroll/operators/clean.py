"""Raw sales -> clean sales (O6): repaired hour, numeric money.

Narrow transformation only: one scan, one projection, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.money import parse_money


def clean_sales(df: DataFrame, ts: str = "datetime", hour: str = "hour_of_day", money: str = "money",
                prefix: str = "R", decimal_mark: str = ",", strict: bool = True) -> DataFrame:
    """Drop ``money`` and ``hour``, then append the hour taken from ``ts`` and the parsed money.

    The timestamp is the trusted source of the hour; the stored hour is derived
    data and may be wrong. Column order therefore changes: the two corrected
    columns come last.
    """
    keep = [c for c in df.columns if c not in (money, hour)]
    return df.select(
        *keep,
        F.hour(ts).cast("long").alias(hour),
        parse_money(money, prefix, decimal_mark, strict).alias(money),
    )
