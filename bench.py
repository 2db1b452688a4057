"""Benchmark: every registered analysis at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned from the star tables and executed into the ``noop``
sink (full execution, no collect). One warm-up pass over all queries, then
the median of $BENCH_REPEATS timed runs per query. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from salescope.plans.registry import star_queries
    from salescope.plans.session import build_session

    scratch = tempfile.mkdtemp(prefix="salescope-bench-")
    spark = build_session(
        master=f"local[{cpus}]",
        shuffle_partitions=max(8, 2 * cpus),
        app_name="salescope-bench",
        checkpoint_dir=os.path.join(scratch, "checkpoints"),
        driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
    )
    queries = star_queries()
    names = only or list(queries)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in names:  # warm-up: JIT, file listing caches, Python workers
        run(name)
    timings = {}
    for name in names:
        timings[name] = round(statistics.median(run(name) for _ in range(repeats)), 4)
    total = round(sum(timings.values()), 4)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "repeats": repeats,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
