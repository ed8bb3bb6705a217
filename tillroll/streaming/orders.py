"""Order grouping on a stream of sales (Structured Streaming form of O9).

Batch grouping keeps item rows; on a stream the natural output is one row per
order, emitted once the order is closed. An order is a session of one
customer's items in which consecutive items are less than ``gap_seconds``
apart: ``session_window`` merges items whose distance is at most its gap, so a
gap of ``gap_seconds`` minus one microsecond reproduces "a new order when
``gap_seconds`` or more passed" at microsecond precision. The watermark bounds
the state: an order is final once event time passed its last item plus the gap
plus the allowed lateness, and only then appended.

Two limits follow. Rows that come later than ``lateness`` after the newest event
time seen are dropped by the watermark. An order is only emitted once it is
closed, so a customer key whose items never pause for ``gap_seconds`` (a busy
shared cash key) has none emitted and its state grows; the batch form has
neither limit.

Watermarks need an instant (``timestamp``) column; a ``timestamp_ntz`` wall
clock is read as UTC, which keeps all distances unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.functions.clock import epoch_micros, is_ntz, timestamp_text
from tillroll.functions.keys import customer_key
from tillroll.functions.money import cents_to_amount, to_cents
from tillroll.session import checkpoint_root


def stream_orders(
    sales: DataFrame,
    ts: str = "datetime",
    value: str = "money",
    gap_seconds: int = 300,
    lateness: str = "10 minutes",
    key: Column | str | None = None,
    id_digits: int = 6,
) -> DataFrame:
    """One row per order: ``order_id, customer_key, order_start, order_end,
    total_products_in_order, total_value_of_order`` (same ids and totals as
    :func:`tillroll.operators.orders.sessionize_orders`)."""
    if not isinstance(gap_seconds, int) or gap_seconds < 1:
        raise ValueError(f"gap_seconds must be a whole number of seconds >= 1, not {gap_seconds!r}")
    ntz = is_ntz(sales, ts)
    k = customer_key() if key is None else (F.col(key) if isinstance(key, str) else key)
    event = F.timestamp_micros(epoch_micros(F.col(ts), ntz)) if ntz else F.col(ts)
    gap = f"{gap_seconds * 1_000_000 - 1} microseconds"
    d = (sales.withColumn("customer_key", k)
              .withColumn("__cents", to_cents(value))
              .withColumn("__event", event)
              .withWatermark("__event", lateness))
    per = d.groupBy(F.session_window("__event", gap).alias("__w"), "customer_key").agg(
        F.min(ts).alias("order_start"), F.max(ts).alias("order_end"),
        F.count(F.lit(1)).alias("total_products_in_order"),
        F.sum("__cents").alias("__c"), F.count("__cents").alias("__nn"))
    return per.select(
        F.concat(timestamp_text(F.col("order_start"), ntz, id_digits), F.lit("+00_"), F.col("customer_key")).alias("order_id"),
        "customer_key", "order_start", "order_end", "total_products_in_order",
        F.when(F.col("__nn") > 0, cents_to_amount(F.col("__c"))).alias("total_value_of_order"),
    )


def start_order_stream(orders: DataFrame, path: str, name: str = "orders", trigger: str | None = None) -> StreamingQuery:
    """Append closed orders to Parquet at ``path``.

    The stream's checkpoint lives under the session's shared checkpoint folder,
    keyed by ``name``: a restarted driver or lost executors resume from the
    last committed batch of the stream with that name.
    """
    spark = orders.sparkSession
    w = (orders.writeStream.outputMode("append").format("parquet")
               .option("path", path)
               .option("checkpointLocation", f"{checkpoint_root(spark).rstrip('/')}/stream-{name}"))
    if trigger:
        w = w.trigger(processingTime=trigger)
    return w.start()
