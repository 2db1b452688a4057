"""CSV sink formatting and the batch export, read back from disk, plus the
golden-file schemas and a replay of the golden growth and rolling columns."""

import csv
import glob
import os

from salescope.sources import csv_export as ce
from salescope.sources.star import order_lines

# The headers of the exported files.
GOLDEN_COLUMNS = {
    "revenue_by_region.csv": "Market,Region,revenue,profit,profit_margin_pct,total_orders,unique_customers,avg_order_value",
    "rfm_segment_summary.csv": "rfm_segment,customer_count,pct_of_base,avg_lifetime_spend,avg_orders,avg_days_since_last_order",
    "monthly_revenue_mom_growth.csv": "yr_mo,year,month,revenue,profit,margin_pct,orders,prev_month_revenue,mom_growth_pct,rolling_3mo_avg",
    "shipping_mode_breakdown.csv": "Ship_Mode,total_orders,pct_of_orders,avg_ship_days,min_ship_days,max_ship_days,profit_margin_pct,avg_order_line_value",
}


def read_single(path):
    parts = glob.glob(os.path.join(path, "part-*.csv"))
    assert len(parts) == 1
    with open(parts[0], newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


def test_plain_numbers_quotes_and_nulls(spark, scratch_dir):
    df = spark.createDataFrame(
        [("a \"q\", b", 12642501.93, 5585.0, None, 3), ("", 0.04, -7.83, 1.0, None)],
        "s string, big double, whole double, n double, k bigint",
    )
    path = os.path.join(scratch_dir, "fmt")
    ce.export_csv(df.orderBy("k"), path, single_file=True)
    rows = read_single(path)
    assert rows[0] == ["s", "big", "whole", "n", "k"]
    assert ["", "0.04", "-7.83", "1.0", ""] in rows
    assert ['a "q", b', "12642501.93", "5585.0", "", "3"] in rows


def test_export_all_writes_four_files_with_golden_headers(spark, sf_dir, scratch_dir):
    out = os.path.join(scratch_dir, "exports")
    manifest = {r["file"]: r for r in ce.export_all(spark, order_lines(spark, sf_dir), out).collect()}
    assert set(manifest) == set(GOLDEN_COLUMNS)
    for name, header in GOLDEN_COLUMNS.items():
        rows = read_single(manifest[name]["path"])
        assert ",".join(rows[0]) == header
        assert len(rows) - 1 == manifest[name]["rows"] > 0
    monthly = read_single(manifest["monthly_revenue_mom_growth.csv"]["path"])
    assert monthly[1][7] == "" and monthly[1][8] == ""  # first month: no previous
    assert [r[0] for r in monthly[1:]] == sorted(r[0] for r in monthly[1:])


def test_copy_of_lines_is_removed(spark, sf_dir, scratch_dir):
    copies = os.path.join(scratch_dir, "copies")
    out = os.path.join(scratch_dir, "exports-2")
    manifest = ce.export_all(spark, order_lines(spark, sf_dir), out, names=["shipping_mode_breakdown.csv"], lines_dir=copies)
    assert manifest.count() == 1 and os.listdir(copies) == []


def test_materialized_tables_are_released(spark):
    from salescope.plans.session import checkpoint_dir, materialize, release_materialized

    release_materialized(spark)
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert materialize(spark.range(3)).count() == 3
    assert len(set(os.listdir(folder)) - before) == 1
    assert release_materialized(spark) == 1
    assert set(os.listdir(folder)) == before


def test_replay_golden_growth_from_revenue_column(spark):
    """Feed the golden monthly revenue into the growth expressions: the growth
    column follows exactly and the rolling mean within 0.01 (it averages
    unrounded revenue upstream)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from salescope.functions import pct, round_half_up

    # The first four months of the golden monthly export.
    golden = [
        ("2011-01", 98898.49, None, 98898.49),
        ("2011-02", 91152.16, -7.83, 95025.32),
        ("2011-03", 145729.37, 59.87, 111926.67),
        ("2011-04", 116915.76, -19.77, 117932.43),
    ]
    df = spark.createDataFrame([(m, r) for m, r, _, _ in golden], "yr_mo string, revenue double")
    w = Window.orderBy("yr_mo")
    prev = F.lag("revenue").over(w)
    roll = F.avg("revenue").over(w.rowsBetween(-2, 0))
    out = df.select("yr_mo", round_half_up(pct(F.col("revenue") - prev, prev), 2).alias("g"), roll.alias("r")).orderBy("yr_mo").collect()
    for (m, _, g, r), row in zip(golden, out):
        assert row["g"] == g
        assert abs(row["r"] - r) <= 0.01


def test_replay_golden_shares_and_order_values(spark):
    """The share and per-order columns of the golden exports follow from their
    count and revenue columns through our expressions."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from salescope.functions import pct, round_half_up, safe_ratio

    # customer_count and pct_of_base of the golden RFM summary.
    segments = [("Champion", 486, 30.6), ("Loyal", 416, 26.2), ("At Risk", 411, 25.8), ("Lost", 277, 17.4)]
    # total_orders and pct_of_orders of the golden ship-mode breakdown.
    modes = [("Same Day", 1347, 5.3), ("First Class", 3821, 15.0), ("Second Class", 5119, 20.1), ("Standard Class", 15154, 59.6)]
    for rows in (segments, modes):
        df = spark.createDataFrame(rows, "k string, n bigint, want double")
        got = df.select("want", round_half_up(pct("n", F.sum("n").over(Window.partitionBy())), 1).alias("got"))
        assert all(r["got"] == r["want"] for r in got.collect())
    # Revenue, total_orders and avg_order_value of three golden regions.
    regions = [(66928.17, 201, 332.98), (848309.78, 1150, 737.66), (752826.57, 1026, 733.75)]
    df = spark.createDataFrame(regions, "rev double, orders bigint, want double")
    got = df.select("want", round_half_up(safe_ratio("rev", "orders"), 2).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
