"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  Every timing forces the whole
plan with the ``noop`` sink (no driver collect); one warm-up run, then the
median of ``$BENCH_RUNS`` (default 5) runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "first_touch_attribution",        # flagship, running-frame form
    "first_touch_attribution_join",   # same result, equi-join form
    "first_touch_attribution_24h",
    "attribution_volume",             # lineitem x orders, 90-day look-back
    "impression_rollup",
    "publisher_series",               # capped series incl. trailing conversions
    "fraud_report",
    "conversion_rate_windows",
    "conversion_timeline",
    "query_log_patterns",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from clickpath.plans import QUERIES
    from clickpath.session import build_session
    spark = build_session(f"local[{cpus}]", app="clickpath-bench", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    timings = {}
    for name in (only or HEADLINE):
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        secs = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            secs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(secs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
