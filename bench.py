"""Benchmark: wall time of every keyed query at one scale factor.

Each query is built and fully executed into Spark's no-op sink (no driver
collect); one warm-up pass, then the median of ``BENCH_REPS`` timed passes.
Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_REPS (default 3), BENCH_KEYS (optional comma list).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

    from storelens.plans.registry import ENTRIES, run
    from storelens.session import local_session
    from storelens.sources.tables import load_tables

    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="storelens-bench")
    keys = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k] or list(ENTRIES)

    def once(key: str) -> float:
        t0 = time.perf_counter()
        df = run(key, spark, sf_dir, load_tables(spark, sf_dir))
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    results: dict[str, float] = {}
    for key in keys:
        once(key)  # warm-up
        results[key] = round(statistics.median(once(key) for _ in range(reps)), 4)
        print(f"{key}: {results[key]:.3f}s", file=sys.stderr)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "reps": reps}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
