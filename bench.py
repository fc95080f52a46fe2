"""Headline-query benchmark: prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query, default 3; median reported).
Each query is fully executed with the no-op sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tablelens.plans.catalog import QUERIES  # noqa: E402
from tablelens.session import get_session  # noqa: E402

HEADLINE = ["profile", "describe_numeric", "correlation_matrix", "groupby_median",
            "anomaly_detection", "trend_month", "mask_table", "rate_admission"]


def run_once(spark, name, sf_dir):
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 1),
                        app_name="tablelens-bench")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run_once(spark, name, sf_dir)  # warm-up: JIT, file listing, codegen cache
        times[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir)[2:] if os.path.basename(sf_dir).startswith("sf") else sf_dir
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
