"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR: data folder; BENCH_CPUS: cores; BENCH_QUERIES: comma-separated names (default all);
BENCH_RUNS: timed runs per query, the median counts (default 1, after one warm-up of the session).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from runlens.plans.queries import QUERIES  # noqa: E402
from runlens.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.sql.files.maxPartitionBytes": "16m"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["trace_terminal"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
