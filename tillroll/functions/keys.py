"""Derived keys used by several reports: customer, period, order id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def customer_key(card: Column | str = "card", cash_type: Column | str = "cash_type") -> Column:
    """The card id, else ``'CASH_' || cash_type`` (NULL when both are NULL: concat propagates)."""
    card = F.col(card) if isinstance(card, str) else card
    cash = F.col(cash_type) if isinstance(cash_type, str) else cash_type
    return F.when(card.isNotNull(), card).otherwise(F.concat(F.lit("CASH_"), cash))


def period_start(d: Column, period: str) -> Column:
    """First day of the month or quarter containing date ``d``."""
    if period == "month":
        return F.trunc(d, "month")
    if period == "quarter":
        return F.trunc(d, "quarter")
    raise ValueError(f"period must be 'month' or 'quarter', not {period!r}")


def period_key(d: Column, period: str) -> Column:
    """Text key of a period: ``2024-05`` or ``2024-Q2`` (sorts in time order)."""
    if period == "month":
        return F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(F.month(d).cast("string"), 2, "0"))
    if period == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    raise ValueError(f"period must be 'month' or 'quarter', not {period!r}")


def period_months(period: str) -> int:
    return {"month": 1, "quarter": 3}[period]
