"""Flat order lines derived from the star-schema test tables.

orders -> customer -> nation -> region, lineitem -> orders and part, all inner equi-joins on keys. No broadcast hint: Spark broadcasts a dimension
only when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``
(and AQE re-checks at run time), so a dimension that grows with the data
falls back to a sort-merge join instead of exhausting executor memory. The
fact-to-fact join with orders is always a sort-merge join.
Only the columns an analysis uses survive column pruning into the scans.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.schema import MONEY, RATE

# Order priority -> ship mode, and nation key // 5 -> region name.
SHIP_MODE_BY_PRIORITY = {
    "1-URGENT": "Same Day",
    "2-HIGH": "First Class",
    "3-MEDIUM": "Second Class",
}
OTHER_SHIP_MODE = "Standard Class"
REGION_BY_NATION_GROUP = {0: "North", 1: "South", 2: "Central", 3: "East"}
OTHER_REGION = "West"


# Declared read schemas (only the columns used): no footer inference per read.
STAR_COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_type string, p_brand string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ship_lag(priority, key):
    """Days from order to shipment, by priority: k%2, 1+k%3, 2+k%4, 4+k%4."""
    return (
        F.when(priority == "1-URGENT", key % 2)
        .when(priority == "2-HIGH", 1 + key % 3)
        .when(priority == "3-MEDIUM", 2 + key % 4)
        .otherwise(4 + key % 4)
    ).cast("int")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat order lines (schema :data:`salescope.schema.ORDER_LINE_SCHEMA`)."""
    li = _table(spark, sf_dir, "lineitem")
    od = _table(spark, sf_dir, "orders")
    cu = _table(spark, sf_dir, "customer")
    na = _table(spark, sf_dir, "nation")
    rg = _table(spark, sf_dir, "region")
    pa = _table(spark, sf_dir, "part")

    # Orders meet their dimensions first, at a quarter of the fact rows; the wide
    # orders then meet lineitem on the order key. With dimensions too large to
    # broadcast only orders are shuffled by customer, and lineitem once by order
    # and once by part. orders grows with lineitem: sort-merge join whatever its
    # size on a small test folder; its shuffle also spreads a fact table stored as
    # one Parquet row group over all tasks.
    placed = (
        od.join(cu, od.o_custkey == cu.c_custkey)
        .join(na, F.col("c_nationkey") == na.n_nationkey)
        .join(rg, F.col("n_regionkey") == rg.r_regionkey)
    )
    joined = li.join(placed.hint("merge"), li.l_orderkey == F.col("o_orderkey")).join(
        pa, F.col("l_partkey") == pa.p_partkey
    )

    order_date = F.col("o_orderdate").cast("date")
    priority = F.col("o_orderpriority")
    mode = F.lit(OTHER_SHIP_MODE)
    for p in reversed(list(SHIP_MODE_BY_PRIORITY)):
        mode = F.when(priority == p, F.lit(SHIP_MODE_BY_PRIORITY[p])).otherwise(mode)
    group = F.expr("n_nationkey div 5")
    region = F.lit(OTHER_REGION)
    for g in sorted(REGION_BY_NATION_GROUP, reverse=True):
        region = F.when(group == g, F.lit(REGION_BY_NATION_GROUP[g])).otherwise(region)

    discount = (F.col("l_discount").cast("decimal(4,2)") * F.lit(5)).cast(RATE)
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    quarter = F.lit(Decimal("0.25")).cast("decimal(4,2)")

    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("Row_ID"),
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("Order_ID"),
        order_date.alias("Order_Date"),
        F.date_add(order_date, _ship_lag(priority, F.col("o_orderkey"))).alias("Ship_Date"),
        mode.alias("Ship_Mode"),
        F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("Customer_ID"),
        F.col("c_name").alias("Customer_Name"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("n_name").alias("Country"),
        F.col("r_name").alias("Market"),
        region.alias("Region"),
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("Product_ID"),
        F.col("p_type").alias("Category"),
        F.col("p_brand").alias("Sub_Category"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        discount.alias("Discount"),
        (price * (F.lit(1) - discount)).cast(MONEY).alias("Sales"),
        (price * (quarter - discount)).cast(MONEY).alias("Profit"),
    )
