"""Benchmark: the reference's flow at one scale, printed as one JSON line.

raw sales -> clean table -> order table (both written as Parquet under the
checkpoint folder, as the reference creates tables), then every report on the
written order table, plus the basket/customer reports on the star-schema
tables. Each step runs to completion (``noop`` sink: full computation, no
collect). A warm-up pass runs first; the timed pass is reported. Then the
same reports are submitted together from 4 threads to the one session, and
that wall time is reported as ``concurrent_reports_sec`` (throughput of a
shared session; the per-query numbers are sequential latencies).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_DRIVER_MEMORY (default 8g; in local mode the driver heap is all the memory).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.plans.catalog import REPORTS, SOURCES  # noqa: E402
from tillroll.session import build_session, has_root, materialize, use_scratch  # noqa: E402

HEADLINE = [
    "kpi_cube", "top_pairs", "pair_rules", "rfm", "retention_month", "retention_quarter", "growth_month",
    "growth_quarter", "season_weekday_hour", "season_daypart", "daily_deviation", "price_by_daypart",
    "numeric_describe", "distinct_counts", "brand_rules", "customer_retention_month", "order_growth_month",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def one_pass(spark, sf_dir: str) -> dict[str, float]:
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    clean = materialize(SOURCES["clean"](spark, sf_dir), "sales_clean")
    times["build_sales_clean"] = time.perf_counter() - t0
    from tillroll.operators.orders import sessionize_orders
    t0 = time.perf_counter()
    tx = materialize(sessionize_orders(clean), "sales_transactions")
    times["build_sales_transactions"] = time.perf_counter() - t0
    tables = {"clean": clean, "tx": tx}
    for name in HEADLINE:
        src, report = REPORTS[name]
        base = tables.get(src)
        if base is None:
            base = SOURCES[src](spark, sf_dir)
        t0 = time.perf_counter()
        _run(report(base))
        times[name] = time.perf_counter() - t0
    return times


def concurrent_pass(spark, sf_dir: str, threads: int) -> float:
    """Wall time of all headline reports submitted at once from ``threads``
    threads to the one session (the order table built first, as above)."""
    from tillroll.operators.orders import sessionize_orders
    clean = materialize(SOURCES["clean"](spark, sf_dir), "sales_clean")
    tx = materialize(sessionize_orders(clean), "sales_transactions")
    tables = {"clean": clean, "tx": tx}
    jobs = []
    for name in HEADLINE:
        src, report = REPORTS[name]
        base = tables.get(src)
        jobs.append(report(base if base is not None else SOURCES[src](spark, sf_dir)))
    t0 = time.perf_counter()
    with ThreadPoolExecutor(max_workers=threads) as pool:
        list(pool.map(_run, jobs))
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    # local mode: the driver JVM is the whole cluster, so its heap is the executor memory
    mem = os.environ.get("BENCH_DRIVER_MEMORY", "8g")
    spark = build_session(app="tillroll-bench", master=f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": mem})
    spark.sparkContext.setLogLevel("ERROR")
    if not has_root(spark):
        use_scratch(spark, tempfile.mkdtemp(prefix="tillroll-bench-"))
    one_pass(spark, sf_dir)                    # warm-up: JIT, file cache
    times = one_pass(spark, sf_dir)
    concurrent = concurrent_pass(spark, sf_dir, threads=4)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_warm_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "concurrent_reports_sec": round(concurrent, 3),
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
