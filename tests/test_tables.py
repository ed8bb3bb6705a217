"""Table replacement, order table layout, rejected input, checks while writing, ordered export."""

import csv
import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tillroll.operators.customers import retention, rfm
from tillroll.operators.quality import check_rules
from tillroll.plans.catalog import sales_clean, transactions
from tillroll.sources.sales import export_ordered, read_ordered, read_sales_csv, write_checked, write_table
from tillroll.sources.tables import before_month, current_state, read_table, replace_table, write_order_table

SF001 = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="tillroll-tables-")


def broken(spark):
    """Rows of which a late one cannot be computed."""
    return spark.range(1000, numPartitions=4).select(
        F.when(F.col("id") == 999, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))


def test_failed_replacement_leaves_the_old_table(spark):
    path = folder() + "/t"
    assert replace_table(spark.range(5), path) == 1
    before, state = read_table(spark, path), current_state(spark, path)
    with pytest.raises(Exception, match="stop"):
        replace_table(broken(spark), path)
    assert current_state(spark, path) == state and read_table(spark, path).count() == 5
    # a reader goes on with the state that it began with
    replace_table(read_table(spark, path).where("id > 2"), path)
    assert before.count() == 5 and read_table(spark, path).count() == 2
    for _ in range(3):
        number = replace_table(read_table(spark, path).selectExpr("id + 1 AS id"), path)
    states = [n for n in os.listdir(path) if n.startswith("v-")]
    assert len(states) == 2 and {int(n.split("-")[1]) for n in states} == {number, number - 1}
    assert sorted(r.id for r in read_table(spark, path).collect()) == [6, 7]
    with pytest.raises(FileNotFoundError):
        read_table(spark, path + "-none")


@pytest.mark.parametrize("kind", ["path", "catalog"])
def test_write_table_survives_a_failed_write(spark, kind):
    target = folder() + "/t" if kind == "path" else "tillroll_replaced"
    read = (lambda: spark.read.parquet(target)) if kind == "path" else (lambda: spark.table(target))
    write_table(spark.range(5), target)
    with pytest.raises(Exception, match="stop"):
        write_table(broken(spark), target)
    assert read().count() == 5
    write_table(read().where("id < 2"), target)  # rebuilt from itself
    assert read().count() == 2
    if kind == "path":
        assert os.listdir(os.path.dirname(target)) == ["t"]
    else:
        assert [t.name for t in spark.catalog.listTables() if t.name.startswith("tillroll_replaced")] == [target]
        spark.sql(f"DROP TABLE {target}")


def test_order_table_prunes_months_and_needs_no_exchange(spark):
    tx = transactions(spark, SF001)
    stored = write_order_table(tx, "tillroll_orders", buckets=4)
    assert stored.drop("order_month").exceptAll(tx).count() == 0 and stored.count() == tx.count()
    off = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    plain = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert spark.conf.get(off) == "true"
        cut = retention(before_month(stored, "2025-03-01"), period="month")
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(order_month" in plan and "Bucketed: true" in plan
        assert "hashpartitioning(__c" not in plan and plan.count("hashpartitioning") == 1  # of the periods
        value = rfm(stored)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in value and "hashpartitioning(card" not in value
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", plain)
    want = retention(tx, period="month", cutoff="2025-03-01").collect()
    assert cut.collect() == want
    assert sorted(map(tuple, rfm(stored).collect())) == sorted(map(tuple, rfm(tx).collect()))
    with pytest.raises(ValueError):
        before_month(stored, "2025-03-02")
    spark.sql("DROP TABLE tillroll_orders")


def test_rejected_records(spark):
    root = folder()
    header = "date,datetime,hour_of_day,cash_type,card,money,coffee_name,Time_of_Day,Weekday,Month_name,Weekdaysort,Monthsort"
    good = '2024-03-01,2024-03-01 10:15:50.52,10,card,ANON-1,"R38,70",Latte,Morning,pt.,Mar,5,3'
    rows = [good, good.replace("ANON-1", ""), good.replace("2024-03-01,", "2024-02-31,", 1), good.replace("R38,70", "R38;x"),
            good.rsplit(",", 2)[0], good + ",more", good.replace(",10,", ",ten,")]
    with open(f"{root}/sales.csv", "w") as f:
        f.write("\n".join([header, *rows]) + "\n")
    typed, rejected = read_sales_csv(spark, f"{root}/sales.csv")
    got = typed.collect()
    assert len(got) == 2 and got[0]["date"] == dt.date(2024, 3, 1) and got[0]["hour_of_day"] == 10
    assert got[0]["datetime"] == dt.datetime(2024, 3, 1, 10, 15, 50, 520000) and got[1]["card"] is None
    assert sorted(r["reject_reason"] for r in rejected.collect()) == ["date", "fields", "fields", "hour_of_day", "money"]
    assert all(r["raw_record"] for r in rejected.collect())
    with pytest.raises(Exception, match="rejected record"):
        read_sales_csv(spark, f"{root}/sales.csv", strict=True)[0].collect()
    with open(f"{root}/fine.csv", "w") as f:
        f.write("\n".join([header, good]) + "\n")
    typed, rejected = read_sales_csv(spark, f"{root}/fine.csv", strict=True)
    assert typed.count() == 1 and rejected.count() == 0


def test_rules_are_counted_while_writing(spark):
    rules = {"cheap": F.col("money") < 20, "hour": F.col("hour_of_day") != F.hour("datetime"), "no card": F.col("card").isNull()}
    clean = sales_clean(spark, SF001)
    path = folder() + "/clean"
    got = write_checked(clean, path, rules)
    assert got.pop("rows") == spark.read.parquet(path).count() == clean.count()
    assert got == {r["rule"]: r["violations"] for r in check_rules(clean, rules).collect()}


def test_ordered_export_in_parts(spark):
    tx = transactions(spark, SF001).select("order_id", "money", "datetime")
    path = folder() + "/report"
    assert export_ordered(tx, path, ["datetime", F.desc("money"), "order_id"], rows_per_part=200) == 1280
    rows = []
    parts = read_ordered(spark, path)
    assert parts == sorted(parts) and len(parts) > 4
    for part in parts:
        with open(part.removeprefix("file:")) as f:
            own = list(csv.DictReader(f))
        rows += [(r["datetime"], -float(r["money"]), r["order_id"]) for r in own]
    assert len(rows) == 1280 and rows == sorted(rows)
    listed = spark.read.option("header", "true").csv(f"{path}/manifest").orderBy("part").collect()
    assert sum(int(r["rows"]) for r in listed) == 1280 and listed[0]["first_row"] == "0"
