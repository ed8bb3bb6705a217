"""The exported result sets of the original analysis, written as CSV in one call.

The clean table and the order table are built once and written under the
checkpoint folder (as the original creates tables); each report then reads the
written order table. Reports bounded by the calendar or by a top-k limit are
written as one file; the per-customer report stays one file per partition.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from tillroll.operators.clean import clean_sales
from tillroll.operators.orders import sessionize_orders
from tillroll.plans.catalog import REPORTS
from tillroll.session import materialize
from tillroll.sources.sales import export_report

# result set -> (registered report, one file?)
EXPORTS: dict[str, tuple[str, bool]] = {
    "growth_month": ("growth_month", True),
    "growth_quarter": ("growth_quarter", True),
    "retention_month": ("retention_month", True),
    "retention_quarter": ("retention_quarter", True),
    "top_pairs": ("top_pairs", True),
    "pair_rules": ("pair_rules", True),
    "daily_deviation": ("daily_deviation_export", True),
    "rfm": ("rfm", False),
}


def export_reference_set(raw_sales: DataFrame, out_dir: str) -> dict[str, str]:
    """Clean, group into orders, then write every result set under ``out_dir``;
    returns result set -> folder."""
    clean = materialize(clean_sales(raw_sales), "sales_clean")
    tx = materialize(sessionize_orders(clean), "sales_transactions")
    written = {}
    for name, (report, single) in EXPORTS.items():
        src, fn = REPORTS[report]
        path = os.path.join(out_dir, name)
        export_report(fn(tx if src == "tx" else clean), path, single_file=single)
        written[name] = path
    return written
