"""Times of the headline queries and rates of the store's batch operations, as one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3; the median counts, after one warm-up).
The store's part writes 100,000 entries of 50-byte keys and 500-byte values, the shape of the published baseline, and reads them by batches.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from moraine.plans import acceptance  # noqa: E402
from moraine.store import Store  # noqa: E402

HEADLINE = ["latest_snapshot", "run_merge", "log_replay", "flush_runs", "run_manifest", "sparse_index", "cluster_locate", "multi_get", "search_stats", "range_prune", "seek_histogram", "runs_with_key", "compaction_pick", "compact_gc", "manifest_swap", "memtable_bytes"]
ENTRIES = 100_000


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def store_rates(spark: SparkSession, runs: int) -> dict[str, float]:
    """Rows a second of each batch operation: the median over ``runs`` fresh stores."""
    def text(salt, n):
        return F.substring(F.concat(*[F.sha2(F.concat_ws(":", F.lit(f"{salt}{i}"), "id"), 256) for i in range(-(-n // 64))]), 1, n).cast("binary")

    rows = spark.range(ENTRIES).select(text("k", 50).alias("key"), text("v", 500).alias("value")).cache()
    rows.count()
    got: dict[str, list[float]] = {}
    for _ in range(runs + 1):
        top = tempfile.mkdtemp()
        with Store.open(spark, top) as store:
            steps = {
                "append": (ENTRIES, lambda: store.put_all(rows)),
                "flush": (ENTRIES, store.flush),
                "multi_get_10k": (10_000, lambda: noop(store.multi_get(rows.limit(10_000)))),
                "multi_get_100k": (ENTRIES, lambda: noop(store.multi_get(rows))),
                "scan": (ENTRIES, lambda: noop(store.snapshot())),
                "compact": (ENTRIES, store.compact_all),
            }
            for name, (n, step) in steps.items():
                got.setdefault(name, []).append(n / timed(step))
        shutil.rmtree(top, ignore_errors=True)
    return {f"store_{k}_rows_per_sec": round(statistics.median(v[1:]), 1) for k, v in got.items()}


def main() -> None:
    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = acceptance.queries(), {}
    for name in HEADLINE:
        times[name] = round(statistics.median([timed(lambda q=name: noop(queries[q](spark, sf))) for _ in range(runs + 1)][1:]), 4)
    rates = store_rates(spark, runs)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
