"""Revenue and profitability.

Windows here run over aggregated periods (years, months): tens to
thousands of rows whatever the line count, so their single-partition
ordering is bounded. No window ever runs over raw lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions import (
    count_rows,
    margin_pct,
    money,
    pct,
    round_half_up,
    safe_ratio,
    year_text,
)
from salescope.operators.common import monthly_base


def growth_pct(cur: str, prev) -> F.Column:
    """100 * (cur - prev) / prev on exact DECIMAL difference, as DOUBLE."""
    return pct(F.col(cur) - prev, prev)


def annual_summary(lines: DataFrame) -> DataFrame:
    """Revenue, profit, margin, orders per year and year-over-year growth."""
    annual = (
        lines.groupBy(F.trunc("Order_Date", "year").alias("_year"))
        .agg(
            F.sum("Sales").alias("_sales"),
            F.sum("Profit").alias("_profit"),
            F.countDistinct("Order_ID").alias("total_orders"),
        )
        .withColumn("order_year", year_text("_year"))
    )
    prev = F.lag("_sales").over(Window.orderBy(F.col("order_year").asc()))
    return annual.select(
        "order_year",
        money("_sales").alias("revenue"),
        money("_profit").alias("profit"),
        margin_pct("_profit", "_sales").alias("profit_margin_pct"),
        "total_orders",
        round_half_up(growth_pct("_sales", prev), 2).alias("yoy_revenue_growth_pct"),
    ).orderBy("order_year")


def region_pnl(lines: DataFrame, by: Sequence[str] = ("Market", "Region")) -> DataFrame:
    """P&L per (Market, Region), sorted by margin."""
    by = list(by)
    summary = lines.groupBy(*by).agg(
        F.sum("Sales").alias("_sales"),
        F.sum("Profit").alias("_profit"),
        F.countDistinct("Order_ID").alias("total_orders"),
        F.countDistinct("Customer_ID").alias("unique_customers"),
    )
    return summary.select(
        *by,
        money("_sales").alias("revenue"),
        money("_profit").alias("profit"),
        margin_pct("_profit", "_sales").alias("profit_margin_pct"),
        "total_orders",
        "unique_customers",
        round_half_up(safe_ratio("_sales", "total_orders"), 2).alias("avg_order_value"),
    ).orderBy(F.col("profit_margin_pct").desc(), *by)


def margin_ranking(
    lines: DataFrame,
    by: Sequence[str] = ("Category", "Sub_Category"),
    k: int = 10,
    min_lines: int = 50,
    ascending: bool = False,
) -> DataFrame:
    """Top or bottom k groups by margin among groups with enough lines."""
    by = list(by)
    groups = lines.groupBy(*by).agg(
        count_rows().alias("order_lines"),
        F.sum("Sales").alias("_sales"),
        F.sum("Profit").alias("_profit"),
        F.sum("Quantity").alias("_units"),
    )
    margin = F.col("profit_margin_pct")
    return (
        groups.where(F.col("order_lines") >= min_lines)
        .select(
            *by,
            "order_lines",
            money("_sales").alias("revenue"),
            money("_profit").alias("profit"),
            margin_pct("_profit", "_sales").alias("profit_margin_pct"),
            round_half_up(safe_ratio("_sales", "_units"), 2).alias("avg_unit_price"),
        )
        .orderBy(margin.asc() if ascending else margin.desc(), *[F.col(c).asc() for c in by])
        .limit(k)
    )


def top_margin(lines: DataFrame, **kw) -> DataFrame:
    """Best margins."""
    return margin_ranking(lines, ascending=False, **kw)


def bottom_margin(lines: DataFrame, **kw) -> DataFrame:
    """Worst margins."""
    return margin_ranking(lines, ascending=True, **kw)


def trailing_mean(col: str, order: str, rows: int) -> F.Column:
    """AVG over the current row and ``rows - 1`` before it (partial at the start)."""
    w = Window.orderBy(F.col(order).asc()).rowsBetween(-(rows - 1), 0)
    return safe_ratio(F.sum(col).over(w), F.count(col).over(w))


def monthly_trend(lines: DataFrame, window: int = 3, base: DataFrame | None = None) -> DataFrame:
    """A10: one row per year-month with a trailing average of revenue."""
    m = monthly_base(lines, base=base)
    return m.select(
        "yr_mo",
        F.col("yr").alias("year"),
        F.col("mo").alias("month"),
        money("sales").alias("revenue"),
        money("profit_sum").alias("profit"),
        margin_pct("profit_sum", "sales").alias("profit_margin_pct"),
        F.col("orders").alias("monthly_orders"),
        round_half_up(trailing_mean("sales", "yr_mo", window), 2).alias(
            f"rolling_{window}mo_avg_revenue"
        ),
    ).orderBy("yr_mo")
