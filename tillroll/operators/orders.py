"""Group single items into orders by customer and time gap (O9).

An item starts a new order when it is the customer's first, or when at least
``gap_seconds`` whole seconds passed since the customer's previous item. Rows
stay at item grain; each row gets the order id (text of the order's first
timestamp + ``_`` + customer key), the order's item count and its total value.
Items at the same instant share one order (the running count includes peers).

Three exact forms give the same rows:

* ``method="window"``: one window partitioned by customer, as the SQL reads.
  Every row of a customer lands in one task, so one hot key (all cash sales
  share ``CASH_cash``) becomes one giant task.
* ``method="chunked"``: items are exchanged once, by (customer, time
  chunk); a chunk is a day wide unless ``chunk_seconds`` says otherwise. Windows
  inside a chunk find the gaps, the groups and their totals. One edge row per
  (customer, chunk) carries what crosses chunk borders: last instant, open
  order, totals of the first and the last group. Windows over the edge rows
  (at most time span / chunk per customer) complete them, and they join the
  items, which are where the join wants them. A hot key's rows are spread over
  its chunks.
* ``method="density"`` (default): chunk borders follow the rows. Items are counted
  per customer first. A customer of up to ``chunk_rows`` items goes through the
  window, which is one exchange. Only the others (few: total / ``chunk_rows`` of
  them at most) are cut into chunks: cells whose width comes from the customer's
  items per time span, then, where a cell holds more than ``chunk_rows`` items,
  narrower cells inside it, again by its own density, until no cell is over that
  or it is a single instant, which no border can part. So a chunk is bounded
  however the time line is filled: one busy day or second is cut as finely as
  it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.clock import epoch_micros, epoch_seconds, is_ntz, timestamp_text, whole_seconds_between
from tillroll.functions.keys import customer_key
from tillroll.functions.money import MONEY_SCALE, cents_to_amount, small_floor_div, to_cents

# Cells of a customer's time line that are counted or broadcast at once; beyond it chunks grow with the input.
MOST_CHUNKS = 100_000
HELPERS = ["customer_key", "previous_datetime", "time_diff_seconds", "order_group_id"]


def sessionize_orders(
    df: DataFrame,
    ts: str = "datetime",
    value: str = "money",
    gap_seconds: int = 300,
    key: Column | str | None = None,
    method: str = "density",
    keep_helpers: bool = False,
    id_digits: int = 6,
    order_id: str = "order_id",
    items_col: str = "total_products_in_order",
    value_col: str = "total_value_of_order",
    tie_break: list[str] | None = None,
    chunk_seconds: int = 86_400,
    money_scale: int = MONEY_SCALE,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Add ``order_id``, ``total_products_in_order``, ``total_value_of_order``.

    ``key`` defaults to the card, else ``'CASH_' || cash_type``. ``keep_helpers``
    also returns ``customer_key``, ``previous_datetime``, ``time_diff_seconds``
    and ``order_group_id``.
    ``tie_break`` orders items of one customer at the same instant for
    ``previous_datetime`` only (which of them sees the earlier instant); order
    assignment never depends on it. ``chunk_seconds`` is the width of a chunk of
    the chunked form, ``chunk_rows`` the most items of a chunk of the density
    form (which counts items when it is called): any value gives the same rows;
    a small one spreads a hot customer further, a large one leaves fewer edge
    rows.
    """
    if not isinstance(gap_seconds, int) or gap_seconds < 1:
        raise ValueError(f"gap_seconds must be a whole number of seconds >= 1, not {gap_seconds!r}")
    if not isinstance(chunk_seconds, int) or chunk_seconds < 1:
        raise ValueError(f"chunk_seconds must be a whole number of seconds >= 1, not {chunk_seconds!r}")
    if not isinstance(chunk_rows, int) or chunk_rows < 1:
        raise ValueError(f"chunk_rows must be a whole number >= 1, not {chunk_rows!r}")
    ntz = is_ntz(df, ts)
    k = customer_key() if key is None else (F.col(key) if isinstance(key, str) else key)
    base_cols = df.columns
    d = df.withColumn("customer_key", k).withColumn("__cents", to_cents(value, money_scale))
    if method == "window":
        out = _by_window(d, ts, ntz, gap_seconds, tie_break or [])
    elif method == "chunked":
        d = _plain_keys(d).withColumn("__ch", small_floor_div(epoch_seconds(F.col(ts), ntz), chunk_seconds))
        out = _by_chunk(d, ts, ntz, gap_seconds, keep_helpers, tie_break or [])
    elif method == "density":
        out = _by_density(d, ts, ntz, gap_seconds, keep_helpers, tie_break or [], chunk_rows)
    else:
        raise ValueError(f"method must be 'density', 'chunked' or 'window', not {method!r}")
    oid = F.concat(timestamp_text(F.col("__ostart"), ntz, id_digits), F.lit("+00_"), F.col("customer_key"))
    total = F.when(F.col("__tnn") > 0, cents_to_amount(F.col("__tcents"), money_scale))
    helpers = HELPERS if keep_helpers else []
    return out.select(
        *base_cols, *helpers,
        oid.alias(order_id),
        F.col("__tcnt").cast("long").alias(items_col),
        total.alias(value_col),
    )


def _by_window(d: DataFrame, ts: str, ntz: bool, gap: int, tie: list[str]) -> DataFrame:
    w = Window.partitionBy("customer_key").orderBy(ts)
    d = d.withColumn("previous_datetime", F.lag(ts).over(Window.partitionBy("customer_key").orderBy(ts, *tie)))
    d = d.withColumn("time_diff_seconds", whole_seconds_between(F.col("previous_datetime"), F.col(ts), ntz))
    start = F.col("time_diff_seconds").isNull() | (F.col("time_diff_seconds") >= gap)
    d = d.withColumn("order_group_id", F.count_if(start).over(w))
    wo = Window.partitionBy("customer_key", "order_group_id")
    return (d.withColumn("__ostart", F.min(ts).over(wo))
             .withColumn("__tcnt", F.count(F.lit(1)).over(wo))
             .withColumn("__tcents", F.sum("__cents").over(wo))
             .withColumn("__tnn", F.count("__cents").over(wo)))


_TOTALS = ["n", "c", "nn"]  # rows, cents, rows with an amount
_KEY = ["__k", "__kn"]


def _plain_keys(d: DataFrame) -> DataFrame:
    """The customer as two plain columns that are never NULL, so that joins on them are ordinary equi-joins on the
    keys the items are partitioned by."""
    return (d.withColumn("__k", F.coalesce(F.col("customer_key").cast("string"), F.lit("")))
             .withColumn("__kn", F.col("customer_key").isNull()))


def _cell_width(least: int, most: int, n: int, rows: int) -> int:
    """Microseconds of cells that would hold half of ``rows`` of the ``n`` items each, were they spread evenly."""
    return -(-(most - least + 1) // -(-2 * n // rows))


def density_chunks(d: DataFrame, ts: str, ntz: bool, chunk_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """(items of customers with up to ``chunk_rows`` items, the other items with their chunk ``__ch``), of items with the
    plain keys; or None if no customer has more. A chunk is named by the microsecond it starts with; items without a
    timestamp have none. It holds ``chunk_rows`` items at most, or those of one instant; if that would need more than
    ``MOST_CHUNKS`` cells at once, as many more as bring it down to that number."""
    spark, micros = d.sparkSession, epoch_micros(F.col(ts), ntz)
    counted = d.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("__from"), F.max(ts).alias("__to"))
    ends = [epoch_micros(F.col(c), ntz).alias(c) for c in ("__from", "__to")]
    # the largest ones: a customer beyond the limit has at most a MOST_CHUNKS-th of all items
    hot = counted.where(F.col("n") > chunk_rows).orderBy(F.desc("n")).limit(MOST_CHUNKS).select(*_KEY, "n", *ends).collect()
    if not hot:
        return None
    rows = max(chunk_rows, sum(r["n"] for r in hot) // MOST_CHUNKS)
    first = [(r["__k"], r["__kn"], r["__from"], 1 if r["__from"] is None else
              _cell_width(r["__from"], r["__to"], r["n"], rows)) for r in hot]
    keys = F.broadcast(spark.createDataFrame(first, "__k string, __kn boolean, __from bigint, __width bigint"))
    cold = d.join(keys, _KEY, "left_anti")

    def cells(df: DataFrame) -> DataFrame:
        return df.withColumn("__ch", micros - F.pmod(micros - F.col("__from"), F.col("__width"))).drop("__from", "__width")

    chunked = cells(d.join(keys, _KEY))
    while True:
        crowded = chunked.where(F.col(ts).isNotNull()).groupBy(*_KEY, "__ch").agg(
            F.count(F.lit(1)).alias("n"), F.min(ts).alias("__from"), F.max(ts).alias("__to"))
        crowded = crowded.where((F.col("n") > rows) & (F.col("__from") < F.col("__to"))).select(
            *_KEY, "__ch", "n", *ends).collect()  # at most 1 / rows of the items
        if not crowded:
            return cold, chunked
        finer = spark.createDataFrame([(r["__k"], r["__kn"], r["__ch"], r["__from"],
                                        _cell_width(r["__from"], r["__to"], r["n"], rows)) for r in crowded],
                                      "__k string, __kn boolean, __ch bigint, __from bigint, __width bigint")
        parted = chunked.join(F.broadcast(finer), [*_KEY, "__ch"], "left").withColumn("__parent", F.col("__ch"))
        chunked = cells(parted).withColumn("__ch", F.coalesce("__ch", "__parent")).drop("__parent")


def _by_density(d: DataFrame, ts: str, ntz: bool, gap: int, keep_helpers: bool, tie: list[str], rows: int) -> DataFrame:
    parts = density_chunks(_plain_keys(d), ts, ntz, rows)
    if parts is None:
        return _by_window(d, ts, ntz, gap, tie)
    cold, hot = _by_window(parts[0], ts, ntz, gap, tie), _by_chunk(parts[1], ts, ntz, gap, keep_helpers, tie)
    both = [c for c in cold.columns if c in hot.columns]
    return cold.select(*both).unionByName(hot.select(*both))


def _by_chunk(d: DataFrame, ts: str, ntz: bool, gap: int, keep_helpers: bool, tie: list[str]) -> DataFrame:
    """Items with the plain keys and their chunk ``__ch``, in order of time; those without a timestamp share a chunk
    before all others."""
    t = F.col(ts)
    kp = _KEY
    p = [*kp, "__ch"]
    d = d.withColumn("__ch", F.coalesce("__ch", F.lit(-(2**63))))

    # Inside the chunk: group 0 runs from its first row to the first gap, the
    # groups after it each start at a gap.
    w = Window.partitionBy(*p).orderBy(ts)
    before = F.lag(ts).over(Window.partitionBy(*p).orderBy(ts, *tie))
    wide = whole_seconds_between(before, t, ntz) >= gap
    d = d.withColumn("__before", before).withColumn("__g", F.count_if(F.coalesce(wide, F.lit(False))).over(w))
    group = Window.partitionBy(*p, "__g")
    d = (d.withColumn("__gstart", F.min(ts).over(group)).withColumn("__gn", F.count(F.lit(1)).over(group))
          .withColumn("__gc", F.sum("__cents").over(group)).withColumn("__gnn", F.count("__cents").over(group)))

    # One row per chunk: its ends, the number of its last group, and the totals
    # of its first and last one.
    last = [F.max_by(f"__g{x}", "__g").alias(f"__l{x}") for x in _TOTALS]
    first = [F.min_by(f"__g{x}", "__g").alias(f"__f{x}") for x in _TOTALS]
    e = d.groupBy(*p).agg(F.min(ts).alias("__from"), F.max(ts).alias("__to"), F.max("__g").alias("__last"),
                          F.max("__gstart").alias("__lstart"), *first, *last)
    e = _edges(e, kp, ntz, gap)
    j = d.join(e, on=p, how="inner")

    head, tail = F.col("__g") == 0, (F.col("__g") == F.col("__last")) & (F.col("__last") > 0)
    j = j.withColumn("order_group_id", (F.col("__first_id") + F.col("__g")).cast("long"))
    j = j.withColumn("__ostart", F.when(head, F.col("__open_start")).otherwise(F.col("__gstart")))
    for x, name in zip(_TOTALS, ["__tcnt", "__tcents", "__tnn"]):
        j = j.withColumn(name, F.when(head, F.col(f"__head_{x}")).when(tail, F.col(f"__tail_{x}")).otherwise(F.col(f"__g{x}")))
    if keep_helpers:
        j = j.withColumn("previous_datetime", F.coalesce(F.col("__before"), F.when(t.isNotNull(), F.col("__prev"))))
        j = j.withColumn("time_diff_seconds", whole_seconds_between(F.col("previous_datetime"), t, ntz))
    return j


def _edges(e: DataFrame, kp: list[str], ntz: bool, gap: int) -> DataFrame:
    """What a chunk's rows need from the customer's other chunks: ``__prev`` (the
    instant before the chunk), ``__first_id`` (order number of group 0), and start
    and totals of the order that group 0 and the last group belong to."""
    w = Window.partitionBy(*kp).orderBy("__ch")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("__prev", F.lag("__to").over(w))
    e = e.withColumn("__new", F.col("__prev").isNull() | (whole_seconds_between(F.col("__prev"), F.col("__from"), ntz) >= gap))
    # rows without a timestamp each count as a start, but share one order
    starts = F.when(F.col("__from").isNull(), F.col("__fn")).otherwise(F.col("__new").cast("int") + F.col("__last"))
    own = F.when(F.col("__from").isNull(), F.col("__fn")).otherwise(F.col("__new").cast("int"))
    e = e.withColumn("__first_id", F.coalesce(F.sum(starts).over(earlier), F.lit(0)) + own)
    # the last order that starts in a chunk, which the next chunks may go on with: its start, and
    # what it has in its last group (nothing if that is group 0, which is counted with its number)
    more = F.col("__last") > 0
    opened = F.when(more, F.struct(F.col("__lstart").alias("start"), *(F.col(f"__l{x}").alias(x) for x in _TOTALS))).when(
        F.col("__new"), F.struct(F.col("__from").alias("start"), F.lit(0).cast("long").alias("n"),
                                 F.lit(None).cast("decimal(38,0)").alias("c"), F.lit(0).cast("long").alias("nn")))
    e = e.withColumn("__opened", opened).withColumn("__carried", F.last("__opened", ignorenulls=True).over(earlier))
    carried = F.when(~F.col("__new"), F.col("__carried"))
    e = e.withColumn("__open_start", F.when(F.col("__new"), F.col("__from")).otherwise(F.col("__carried.start")))
    same = Window.partitionBy(*kp, "__first_id")
    for x in _TOTALS:
        e = e.withColumn(f"__heads_{x}", F.sum(f"__f{x}").over(same))
    # the tail's order goes on if the next chunk's group 0 has its number
    goes_on = F.lead("__first_id").over(w) == F.col("__first_id") + F.col("__last")
    for x in _TOTALS:
        e = e.withColumn(f"__head_{x}", _plus(F.col(f"__heads_{x}"), carried[x]))
        e = e.withColumn(f"__tail_{x}", _plus(F.col(f"__l{x}"), F.when(goes_on, F.lead(f"__heads_{x}").over(w))))
    return e.select(*kp, "__ch", "__prev", "__first_id", "__last", "__open_start",
                    *(f"__{side}_{x}" for side in ("head", "tail") for x in _TOTALS))


def _plus(a: Column, b: Column) -> Column:
    """Sum of two totals of which either may be missing."""
    return F.coalesce(a + b, a, b)
