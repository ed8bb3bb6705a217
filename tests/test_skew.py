"""One customer holding every row: the chunked order grouping spreads it, the window form cannot."""

from pyspark.sql import functions as F

from tillroll.operators.orders import density_chunks, sessionize_orders
from tillroll.plans.catalog import sales_clean


def _largest_partition_share(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_hot_key_is_spread_over_chunks(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        clean = sales_clean(spark, "/root/testdata/sf0.01").withColumn("card", F.lit(None).cast("string")) \
                                                         .withColumn("cash_type", F.lit("cash"))
        chunked = sessionize_orders(clean, method="chunked")
        window = sessionize_orders(clean, method="window")
        assert _largest_partition_share(window) == 1.0
        assert _largest_partition_share(chunked) < 0.3
        a = chunked.select("order_id", "total_products_in_order", "total_value_of_order")
        b = window.select("order_id", "total_products_in_order", "total_value_of_order")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_busy_day_of_one_key_is_cut_by_density(spark):
    """One key holds every row and one second of one day most of them: no chunk over the limit but a single instant."""
    start = F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")
    spread = spark.range(2000).select((F.col("id") * 7_200_000_000).alias("us"))
    busy = spark.range(6000).select((F.lit(86_400_000_000 * 30) + F.col("id") * 150).alias("us"))
    tie = spark.range(300).select(F.lit(86_400_000_000 * 31 + 5).cast("long").alias("us"))
    rows = spread.unionByName(busy).unionByName(tie).select(
        F.timestamp_add("MICROSECOND", F.col("us"), start).alias("datetime"), F.lit(None).cast("string").alias("card"),
        F.lit("cash").alias("cash_type"), F.pmod("us", F.lit(900)).cast("double").alias("money"))
    cold, hot = density_chunks(rows.select("*", F.lit("CASH_cash").alias("__k"), F.lit(False).alias("__kn")),
                               "datetime", True, 100)
    sizes = hot.groupBy("__ch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("datetime").alias("instants")).collect()
    assert cold.count() == 0 and sum(r["n"] for r in sizes) == 8300
    assert all(r["n"] <= 100 or r["instants"] == 1 for r in sizes) and max(r["n"] for r in sizes) == 300
    assert len(sizes) < 600
    columns = ["datetime", "order_id", "total_products_in_order", "total_value_of_order"]
    dense = sessionize_orders(rows, chunk_rows=100).select(*columns)
    window = sessionize_orders(rows, method="window").select(*columns)
    assert dense.exceptAll(window).count() == 0 and window.exceptAll(dense).count() == 0


def test_hot_basket_pairs(spark):
    """One basket holds a third of all rows (with repeats)."""
    from tillroll.operators.basket import pair_counts
    items = ["a", "b", "c", "d", "e"]
    rows = [(0, items[i % 5]) for i in range(3000)] + [(b, items[(b + j) % 5]) for b in range(1, 3001) for j in range(2)]
    tx = spark.createDataFrame(rows, "order_id long, coffee_name string")
    got = {(r.product_a, r.product_b): r.co_occurrence_count for r in pair_counts(tx, k=None).collect()}
    assert got[("a", "b")] == 1 + 600   # the hot basket once, plus baskets holding a and b
