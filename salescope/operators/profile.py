"""Data profiling (A01-A05): shape, date coverage, cardinality, NULLs, mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.functions import count_if, count_rows, money, pct, round_half_up
from salescope.operators.common import attach_total
from salescope.operators.ranges import with_total
from salescope.plans.session import materialize
from salescope.schema import BOUNDED_COLUMNS

CARDINALITY_COLUMNS = {
    "Customer_ID": "unique_customers",
    "Product_ID": "unique_products",
    "Region": "unique_regions",
    "Country": "unique_countries",
    "Market": "unique_markets",
}
NULL_AUDIT_COLUMNS = ("Sales", "Profit", "Order_Date", "Customer_ID", "Product_ID", "Quantity")


def dataset_shape(lines: DataFrame) -> DataFrame:
    """Row count and column count (the column count is schema metadata)."""
    return lines.agg(
        count_rows().alias("total_rows"),
        F.lit(len(lines.columns)).cast("bigint").alias("total_columns"),
    )


def date_coverage(lines: DataFrame, date_col: str = "Order_Date") -> DataFrame:
    """First and last date and the number of distinct days."""
    return lines.agg(
        F.min(date_col).alias("earliest_order"),
        F.max(date_col).alias("latest_order"),
        F.countDistinct(date_col).alias("distinct_order_days"),
    )


def cardinality(
    lines: DataFrame, cols: dict[str, str] | None = None, approx: bool = False, rsd: float = 0.05
) -> DataFrame:
    """Exact distinct counts in one pass (Catalyst expands once per column).

    ``approx=True`` uses HyperLogLog++ sketches instead: no expand, one
    partial sketch per task; ``rsd`` is the relative standard deviation of
    the estimate.
    """
    cols = cols or CARDINALITY_COLUMNS
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else (lambda c: F.countDistinct(c))
    return lines.agg(*[fn(c).cast("bigint").alias(name) for c, name in cols.items()])


def null_audit(lines: DataFrame, cols: Sequence[str] = NULL_AUDIT_COLUMNS) -> DataFrame:
    """NULL count per column, one pass."""
    return lines.agg(*[count_if(F.col(c).isNull()).alias(f"null_{c.lower()}") for c in cols])


def category_mix(lines: DataFrame, by: str | Sequence[str] = "Category", k: int = 5) -> DataFrame:
    """The k groups with most lines, their sales and share of all lines. ``by``
    is a column or a list of them. The total is taken over the groups: by a window
    where dimensions bound their number, else by a one-row aggregate of the groups,
    which are written first."""
    by = [by] if isinstance(by, str) else list(by)
    grouped = lines.groupBy(*by).agg(
        count_rows().alias("order_lines"),
        F.sum("Sales").alias("_sales"),
    )
    if set(by) <= BOUNDED_COLUMNS:
        totalled = attach_total(grouped, "order_lines", "_all_lines")
    else:
        totalled = with_total(materialize(grouped), "order_lines", "_all_lines")
    return (
        totalled.select(
            *by,
            "order_lines",
            money("_sales").alias("total_sales"),
            round_half_up(pct("order_lines", "_all_lines"), 1).alias("pct_of_lines"),
        )
        .orderBy(F.col("order_lines").desc(), *[F.col(c).asc() for c in by])
        .limit(k)
    )
