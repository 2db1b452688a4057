"""Scaling check for the range-bucketed NTILE against a single-window NTILE.

Generates N keyed rows where a third of them share one value (the skew the
bucketing has to split) and times three tiles over the whole set, both ways,
into the noop sink. Prints one JSON line per N. Usage:
    python scripts/ntile_scaling.py 2000000 10000000
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from salescope.operators.tiles import TileSpec, with_ntiles  # noqa: E402
from salescope.plans.session import build_session, materialize  # noqa: E402


def main() -> None:
    sizes = [int(a) for a in sys.argv[1:]] or [2_000_000]
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        master=f"local[{cpus}]",
        shuffle_partitions=4 * cpus,
        checkpoint_dir=os.path.join(tempfile.mkdtemp(prefix="salescope-tiles-"), "cp"),
        driver_memory="16g",
    )
    for n in sizes:
        rows = spark.range(n).select(
            F.format_string("C-%09d", "id").alias("Customer_ID"),
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise((F.col("id") * 7919) % 1000).alias("order_count"),
            ((F.col("id") * 104729) % 100003 / 100.0).cast("decimal(18,2)").alias("total_spend"),
        )
        specs = [
            TileSpec(3, (("order_count", True), ("Customer_ID", True)), "f"),
            TileSpec(3, (("total_spend", True), ("Customer_ID", True)), "m"),
            TileSpec(5, (("order_count", False), ("Customer_ID", True)), "r"),
        ]
        src = materialize(rows)

        t = time.perf_counter()
        out = src
        for s in specs:
            exprs = [F.col(c).asc() if a else F.col(c).desc() for c, a in s.order]
            out = out.withColumn(s.out, F.ntile(s.n).over(Window.orderBy(*exprs)))
        out.write.format("noop").mode("overwrite").save()
        single = time.perf_counter() - t

        t = time.perf_counter()
        tiled = with_ntiles(src, specs, materialized=True)
        tiled.write.format("noop").mode("overwrite").save()
        spread = time.perf_counter() - t
        print(json.dumps({"rows": n, "single_window_sec": round(single, 2), "cut_rows_sec": round(spread, 2), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
