"""A hot customer and a hot order holding a third of all lines: every
customer- and order-level analysis still equals its oracle, and the
per-customer steps keep their map-side combine (no window over lines)."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle_compare import compare
from salescope.plans.oracle import FLAT_VIEW, ORACLE_SQL
from salescope.plans.registry import ANALYSES
from salescope.sources.star import order_lines

HOT = [
    "customer_value_overview", "rfm_scores", "rfm_segment_summary", "revenue_concentration",
    "new_vs_returning", "cohort_retention", "cohort_value", "speed_vs_margin",
    "regional_shipping", "ship_mode_performance", "region_pnl",
]


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    key = F.xxhash64("Order_ID") % 3
    hot = lines.withColumn(
        "Customer_ID", F.when(key == 0, F.lit("C-HOT")).otherwise(F.col("Customer_ID"))
    ).withColumn(
        "Customer_Name", F.when(key == 0, F.lit("Hot")).otherwise(F.col("Customer_Name"))
    ).withColumn(
        "Order_ID", F.when(key == 1, F.lit("O-HOT")).otherwise(F.col("Order_ID"))
    )
    rows = hot.collect()  # sf0.001 fixture: a few thousand lines
    df = spark.createDataFrame(rows, hot.schema)
    con = duckdb.connect()
    con.register("skewed_lines", pa.Table.from_pylist([r.asDict() for r in rows]))
    return df, con


@pytest.mark.parametrize("name", HOT)
def test_hot_keys_match_oracle(skewed, name):
    df, con = skewed
    sql = ORACLE_SQL[name].replace(
        FLAT_VIEW,
        "\nf AS (SELECT Row_ID, Order_ID, Order_Date, Ship_Date, Ship_Mode, Customer_ID, Customer_Name, "
        "Segment, Country, Market, Region, Product_ID, Category, Sub_Category, Quantity, "
        "CAST(Discount AS DECIMAL(6,4)) AS Discount, CAST(Sales AS DECIMAL(18,4)) AS Sales, "
        "CAST(Profit AS DECIMAL(18,4)) AS Profit FROM skewed_lines)",
    )
    problems = compare(ANALYSES[name](df), con, sql)
    assert not problems, problems
