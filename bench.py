"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver); the reported time is the median of
$BENCH_RUNS warm runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "top_executors",          # A6, the flagship (entry)
    "catalog",                # J1: 3 joins + visibility + sort
    "orders_enriched",        # J2: order list with both participants
    "platform_stats",         # A1: 16 metrics, one pass per table
    "executor_stats",         # A7: pre-aggregated branches
    "user_full",              # J16: profile JSON + stats
    "inbox",                  # W1: salted top-k per user
    "running_balance",        # W6: bucketed running sum
    "flag_attempt_bursts",    # W4: bucketed trailing counts
    "orphans",                # Q2: 17 anti joins
    "screen_texts",           # Q7: regex screening over whole documents
    "place_orders",           # C1: running sums, scan from the first refusal
    "apply_status_changes",   # C2: first moves per order
    "run_retention",          # R7: mark tables of a full run
    "limit_attempts",         # T1 batch: anchored-window limiter
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from souk.session import get_session
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="souk-bench")
    import importlib.util
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    queries = mod.queries()

    names = only or HEADLINE
    # warm-up: JIT, parquet footers, Python workers
    queries[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()

    results, rows = {}, {}
    for name in names:
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            df = queries[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
