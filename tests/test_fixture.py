"""The events-derived sales table reproduces the checked values of FIXTURES.md section 4."""

import pytest
from pyspark.sql import functions as F

from tillroll.operators.customers import retention, rfm
from tillroll.plans.catalog import sales, transactions

# Checked counts per scale (rows, orders, orders with 1/2/3 items, distinct cards, cash rows,
# rows with a wrong hour, sum of money, card customers with > 1 order, customers / retained in 2024-04).
CHECKED = {
    "/root/testdata/sf0.001": (1280, 1020, (820, 140, 60), 291, 40, 4, "65573.09", 255, (54, 16)),
    "/root/testdata/sf0.01": (12800, 10200, (8200, 1400, 600), 2874, 400, 13, "635419.84", 2499, (592, 180)),
}


@pytest.mark.parametrize("sf_dir", sorted(CHECKED))
def test_checked_values(spark, sf_dir):
    rows, orders, split, cards, cash, wrong, money, repeat, april = CHECKED[sf_dir]
    s = sales(spark, sf_dir)
    r = s.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("card").alias("cards"),
              F.count_if(F.col("card").isNull()).alias("cash"),
              F.count_if(F.col("hour_of_day") != F.hour("datetime")).alias("wrong")).collect()[0]
    assert (r.rows, r.cards, r.cash, r.wrong) == (rows, cards, cash, wrong)
    tx = transactions(spark, sf_dir)
    per = tx.groupBy("order_id").agg(F.max("total_products_in_order").alias("n"))
    dist = {x["n"]: x["count"] for x in per.groupBy("n").count().collect()}
    assert per.count() == orders and (dist[1], dist[2], dist[3]) == split
    total = tx.agg(F.sum(F.col("money").cast("decimal(18,2)"))).collect()[0][0]
    assert str(total) == money
    assert rfm(tx).count() == repeat
    apr = [x for x in retention(tx, cutoff="2025-03-01").collect() if x.period_month == "2024-04"][0]
    assert (apr.end_period_customers, apr.retained_customers) == april
