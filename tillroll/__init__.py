"""tillroll: retail point-of-sale analytics as plain Spark DataFrame functions.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; nothing is
collected to the driver. Column names are parameters, so the same operators run
on the coffee-shop ``sales`` layout and on any other item-grain sales table.
"""

from tillroll.functions.money import parse_money
from tillroll.operators.basket import pair_counts, pair_rules
from tillroll.operators.clean import clean_sales
from tillroll.operators.customers import retention, rfm
from tillroll.operators.kpi import kpi_by, seasonality
from tillroll.operators.orders import sessionize_orders
from tillroll.operators.pricing import price_range, product_history
from tillroll.operators.quality import (
    check_rules,
    crosstab,
    distinct_counts,
    extremes,
    functional_dependency,
    non_null_counts,
    null_audit,
    null_percent,
    numeric_describe,
    preview,
    profile,
    rule_rows,
    value_counts,
)
from tillroll.operators.trends import deviation, growth
from tillroll.session import build_session, checkpoint_root, has_root, materialize, scale_conf, use_scratch
from tillroll.sources.sales import SALES_SCHEMA, export_report, read_sales, write_table
from tillroll.streaming.orders import start_order_stream, stream_orders

__all__ = [
    "SALES_SCHEMA",
    "build_session",
    "checkpoint_root",
    "materialize",
    "parse_money",
    "start_order_stream",
    "stream_orders",
    "check_rules",
    "clean_sales",
    "crosstab",
    "deviation",
    "distinct_counts",
    "export_report",
    "extremes",
    "functional_dependency",
    "growth",
    "kpi_by",
    "non_null_counts",
    "null_audit",
    "null_percent",
    "numeric_describe",
    "pair_counts",
    "pair_rules",
    "preview",
    "price_range",
    "product_history",
    "profile",
    "read_sales",
    "scale_conf",
    "has_root",
    "use_scratch",
    "retention",
    "rfm",
    "rule_rows",
    "seasonality",
    "sessionize_orders",
    "value_counts",
    "write_table",
]
