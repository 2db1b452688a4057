"""CSV sink for result sets (IO-12) and the batch export of the four
reported result sets with a manifest (IO-13).

Doubles are written as plain decimals (``12642501.93``, ``5585.0``), not in
Spark's scientific form; NULL is an empty field; quotes inside fields are
doubled. The exported results are aggregates of at most a few hundred rows,
so the batch export asks for one file each.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.operators import exports
from salescope.operators.bases import shared_bases
from salescope.plans.session import remove_path

# Exported file name and label per result set.
EXPORTS = (
    ("revenue_by_region.csv", "Revenue & profit by region", exports.export_revenue_by_region),
    ("rfm_segment_summary.csv", "RFM segment distribution", exports.export_rfm_segment_summary),
    ("monthly_revenue_mom_growth.csv", "Month-over-month revenue growth", exports.export_monthly_mom_growth),
    ("shipping_mode_breakdown.csv", "Shipping mode performance breakdown", exports.export_ship_mode_breakdown),
)


def plain_number(c: Column) -> Column:
    """A double as plain decimal text with at least one fractional digit."""
    text = c.cast(T.DecimalType(38, 10)).cast("string")
    text = F.regexp_replace(text, "0+$", "")
    return F.regexp_replace(text, r"\.$", ".0")


def csv_ready(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = plain_number(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """IO-12: header row, UTF-8, no index, NULL as an empty field.

    ``single_file`` coalesces the result into one part file, in its order: one
    task writes it, so ask for it on small results only.
    """
    out = csv_ready(df)
    if single_file:
        out = out.coalesce(1)
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def export_all(
    spark: SparkSession,
    lines: DataFrame,
    out_dir: str,
    names: Sequence[str] | None = None,
    lines_dir: str | None = None,
) -> DataFrame:
    """IO-13: run and write every export (or ``names``); return a manifest
    (file, label, rows, path). Row counts are read back from what was written.

    The exports all read the same lines. Where these are no cheap scan, name a
    shared folder as ``lines_dir``: they are written there once, so that the
    upstream plan (e.g. the star joins) runs once, and removed at the end. The monthly
    and the customer base are written once and removed at the end too.
    """
    if lines_dir is not None:
        copy = f"{lines_dir.rstrip('/')}/lines-{uuid.uuid4().hex}"
        lines.write.parquet(copy)
        try:
            return export_all(spark, spark.read.schema(lines.schema).parquet(copy), out_dir, names)
        finally:
            remove_path(spark, copy)
    manifest = []
    with shared_bases(lines) as bases:
        for filename, label, fn in EXPORTS:
            if names is not None and filename not in names and fn.__name__ not in names:
                continue
            path = os.path.join(out_dir, filename)
            export_csv(bases.run(fn), path, single_file=True)
            written = spark.read.option("header", True).csv(path).count()
            manifest.append((filename, label, written, path))
    return spark.createDataFrame(manifest, "file string, label string, rows bigint, path string")
