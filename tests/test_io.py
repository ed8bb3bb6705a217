"""Typed scan (O1), CSV report sink (O18), preview (O3), and filter pushdown into a sales Parquet scan."""

import os
import tempfile

from pyspark.sql import functions as F

from tillroll.operators.quality import preview
from tillroll.operators.trends import growth
from tillroll.plans.catalog import sales, transactions
from tillroll.sources.sales import SALES_SCHEMA, export_report, read_sales, write_table


def test_read_sales_parquet_and_csv_round_trip(spark):
    raw = sales(spark, "/root/testdata/sf0.001")
    root = tempfile.mkdtemp(prefix="tillroll-io-")
    raw.write.mode("overwrite").parquet(os.path.join(root, "pq"))
    back = read_sales(spark, os.path.join(root, "pq"))
    assert back.schema == SALES_SCHEMA
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0
    export_report(raw, os.path.join(root, "csv"))
    csv = read_sales(spark, os.path.join(root, "csv"), fmt="csv")
    assert csv.count() == raw.count()
    assert csv.filter(F.col("card").isNull()).count() == raw.filter(F.col("card").isNull()).count()


def test_export_report_single_file_with_header(spark):
    root = tempfile.mkdtemp(prefix="tillroll-csv-")
    df = spark.createDataFrame([("2024-03", 172, 7050.2)], "sales_month string, monthly_orders long, monthly_revenue double")
    export_report(df, os.path.join(root, "out"), single_file=True)
    parts = [f for f in os.listdir(os.path.join(root, "out")) if f.endswith(".csv")]
    assert len(parts) == 1
    lines = open(os.path.join(root, "out", parts[0])).read().splitlines()
    assert lines == ["sales_month,monthly_orders,monthly_revenue", "2024-03,172,7050.2"]


def test_preview(spark):
    assert preview(sales(spark, "/root/testdata/sf0.001"), 5).count() == 5


def test_cutoff_reaches_parquet_scan(spark):
    root = tempfile.mkdtemp(prefix="tillroll-push-")
    transactions(spark, "/root/testdata/sf0.001").write.mode("overwrite").parquet(root)
    tx = spark.read.parquet(root)
    plan = growth(tx, period="quarter", revenue="total_value_of_order", cutoff="2025-03-01",
                  drop_first=True)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(datetime), LessThan(datetime,2025-03-01T00:00)]" in plan
    assert "ReadSchema: struct<datetime:timestamp_ntz,order_id:string,total_value_of_order:double>" in plan


def test_write_table_replaces(spark):
    root = tempfile.mkdtemp(prefix="tillroll-tbl-")
    path = os.path.join(root, "sales_clean")
    write_table(spark.range(5), path)
    write_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    write_table(spark.range(4), "tillroll_test_table")
    write_table(spark.range(2), "tillroll_test_table")
    assert spark.table("tillroll_test_table").count() == 2


def test_export_reference_set(spark):
    from tillroll.plans.exports import EXPORTS, export_reference_set
    out = tempfile.mkdtemp(prefix="tillroll-export-")
    written = export_reference_set(sales(spark, "/root/testdata/sf0.001"), out)
    assert set(written) == set(EXPORTS)
    growth_csv = [f for f in os.listdir(written["growth_month"]) if f.endswith(".csv")]
    assert len(growth_csv) == 1
    lines = open(os.path.join(written["growth_month"], growth_csv[0])).read().splitlines()
    assert lines[0] == "sales_month,monthly_orders,monthly_revenue,orders_growth_mom,revenue_growth_mom"
    assert len(lines) == 14
    rfm = spark.read.option("header", "true").csv(written["rfm"])
    assert rfm.count() == 255
