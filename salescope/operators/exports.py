"""The four exported result sets (E1-E4), built from the same operators as the
analyses so that the exports and the API cannot drift apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions import margin_pct, mean, money, pct, round_half_up, ship_days
from salescope.operators.common import attach_total, monthly_base
from salescope.operators.customers import rfm_segment_summary
from salescope.operators.profitability import growth_pct, region_pnl, trailing_mean


def export_revenue_by_region(lines: DataFrame) -> DataFrame:
    """The regional P&L (same columns as A07)."""
    return region_pnl(lines)


def export_rfm_segment_summary(lines: DataFrame, as_of=None, **kw) -> DataFrame:
    """The RFM segment summary with the share named ``pct_of_base``."""
    return rfm_segment_summary(lines, as_of=as_of, share_name="pct_of_base", **kw)


def export_monthly_mom_growth(lines: DataFrame, window: int = 3, base: DataFrame | None = None) -> DataFrame:
    """Month-over-month growth plus profit, margin and a trailing mean."""
    m = monthly_base(lines, base=base)
    prev = F.lag("sales").over(Window.orderBy(F.col("yr_mo").asc()))
    return m.select(
        "yr_mo",
        F.col("yr").alias("year"),
        F.col("mo").alias("month"),
        money("sales").alias("revenue"),
        money("profit_sum").alias("profit"),
        margin_pct("profit_sum", "sales").alias("margin_pct"),
        "orders",
        money(prev).alias("prev_month_revenue"),
        round_half_up(growth_pct("sales", prev), 2).alias("mom_growth_pct"),
        round_half_up(trailing_mean("sales", "yr_mo", window), 2).alias(f"rolling_{window}mo_avg"),
    ).orderBy("yr_mo")


def export_ship_mode_breakdown(lines: DataFrame) -> DataFrame:
    """Ship-mode performance with margin and mean line value."""
    days = ship_days()
    per_mode = lines.groupBy("Ship_Mode").agg(
        F.countDistinct("Order_ID").alias("total_orders"),
        round_half_up(mean(days), 2).alias("avg_ship_days"),
        F.min(days).alias("min_ship_days"),
        F.max(days).alias("max_ship_days"),
        margin_pct(F.sum("Profit"), F.sum("Sales")).alias("profit_margin_pct"),
        round_half_up(mean("Sales"), 2).alias("avg_order_line_value"),
    )
    per_mode = attach_total(per_mode, "total_orders", "_all_orders")
    return per_mode.select(
        "Ship_Mode",
        "total_orders",
        round_half_up(pct("total_orders", "_all_orders"), 1).alias("pct_of_orders"),
        "avg_ship_days",
        "min_ship_days",
        "max_ship_days",
        "profit_margin_pct",
        "avg_order_line_value",
    ).orderBy("avg_ship_days", "Ship_Mode")
