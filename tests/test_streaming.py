"""The streaming order grouping closes the same orders as the batch form."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from tillroll.operators.orders import sessionize_orders
from tillroll.plans.catalog import sales_clean
from tillroll.streaming.orders import start_order_stream, stream_orders


def _batch_orders(clean):
    tx = sessionize_orders(clean)
    return {(r.order_id, r.total_products_in_order, r.total_value_of_order)
            for r in tx.select("order_id", "total_products_in_order", "total_value_of_order").distinct().collect()}


def test_stream_matches_batch(spark):
    clean = sales_clean(spark, "/root/testdata/sf0.001")
    root = tempfile.mkdtemp(prefix="tillroll-stream-")
    # several input files, replayed one per micro-batch in time order
    clean.withColumn("__m", F.date_format("date", "yyyyMM")).repartition("__m").write.partitionBy("__m").parquet(
        os.path.join(root, "in"))
    src = (spark.readStream.schema(clean.schema).option("maxFilesPerTrigger", 2)
                .option("recursiveFileLookup", "true").parquet(os.path.join(root, "in")))
    q = (stream_orders(src).writeStream.outputMode("complete").format("memory").queryName("closed_orders")
         .option("checkpointLocation", os.path.join(root, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.order_id, r.total_products_in_order, r.total_value_of_order)
           for r in spark.table("closed_orders").collect()}
    assert got == _batch_orders(clean)


def test_append_to_parquet_with_checkpoint(spark):
    clean = sales_clean(spark, "/root/testdata/sf0.001")
    root = tempfile.mkdtemp(prefix="tillroll-stream-")
    clean.write.parquet(os.path.join(root, "in"))
    src = spark.readStream.schema(clean.schema).parquet(os.path.join(root, "in"))
    # a stream name is a persistent checkpoint (same name = resume); a fresh one per run
    q = start_order_stream(stream_orders(src, lateness="0 seconds"), os.path.join(root, "out"), name=f"t-{uuid.uuid4().hex}")
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(os.path.join(root, "out"))
    # append mode emits closed orders only; everything it emits is a real order
    emitted = {(r.order_id, r.total_products_in_order, r.total_value_of_order) for r in out.collect()}
    assert emitted <= _batch_orders(clean)


def test_orders_close_when_the_watermark_passes(spark):
    import datetime as dt
    schema = "datetime timestamp_ntz, card string, cash_type string, money double"
    t0 = dt.datetime(2024, 3, 1, 10, 0, 0)
    root = tempfile.mkdtemp(prefix="tillroll-wm-")
    first = [(t0, "A", "card", 1.0), (t0 + dt.timedelta(seconds=100), "A", "card", 2.0)]
    later = [(t0 + dt.timedelta(hours=2), "B", "card", 5.0)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(os.path.join(root, "in", "1"))
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
                .parquet(os.path.join(root, "in")))
    name = f"wm_{uuid.uuid4().hex}"
    q = (stream_orders(src, lateness="1 minute").writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(root, "ck")).start())
    q.processAllAvailable()
    assert spark.table(name).count() == 0          # A's order may still grow
    spark.createDataFrame(later, schema).coalesce(1).write.parquet(os.path.join(root, "in", "2"))
    q.processAllAvailable()
    q.stop()
    rows = [(r.order_id, r.total_products_in_order, r.total_value_of_order) for r in spark.table(name).collect()]
    assert rows == [("2024-03-01 10:00:00.000000+00_A", 2, 3.0)]   # closed by the later event; B still open
