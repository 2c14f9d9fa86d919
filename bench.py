"""Benchmark the headline reports.

``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.
Each query is executed in full through the ``noop`` sink (no collect), once
to warm up and then ``$BENCH_RUNS`` times (default 3); the per-query figure is
the median.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from depotlens.plans.registry import REPORTS  # noqa: E402
from depotlens.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    timings = {}
    for name, fn in REPORTS.items():
        if only and name not in only:
            continue
        def run_once():
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        run_once()  # warm-up (JIT, file listing cache)
        timings[name] = round(statistics.median(run_once() for _ in range(runs)), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    try:
        sf_val: float | str = float(sf)
    except ValueError:
        sf_val = sf
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf_val, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
