"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)
os.environ.setdefault("OMP_NUM_THREADS", "1")

from tidewell import catalog  # noqa: E402
from tidewell.session import build_session  # noqa: E402

HEADLINE = [
    "events_daily_recent", "tenant_recent_top50", "events_count_all", "events_by_tenant", "orders_state_recent", "tenant_skew_top15", "skew_top_percent",
    "partition_imbalance", "latest_event_per_tenant", "range_pruned_window", "retention_doomed_count", "list_hash_tree_rows", "whale_count", "long_tail_count",
    "hash_partition_rows", "route_directory", "route_ring", "shard_stats", "state_counts_scatter", "misplaced_after_split", "feed_page1", "feed_page2",
    "snowflake_encode", "join_on_key", "join_reference", "join_repartition", "applied_once", "reshard_verify",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)  # the first run compiles
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
