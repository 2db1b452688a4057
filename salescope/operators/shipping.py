"""Shipping and discounting.

Order-level steps group by (Order_ID, Ship_Mode[, Market, Region]) with
map-side combine, so one huge order is pre-aggregated in every task before
the shuffle. The dominant ship mode comes from windows over counted modes.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions import (
    count_if,
    count_rows,
    day_diff,
    margin_pct,
    mean,
    money,
    pct,
    round_half_up,
    safe_ratio,
    ship_days,
)
from salescope.operators.common import attach_total

# Speed bucket labels (bounds inclusive) and the label for the rest.
SPEED_BUCKETS = (("1. Fast (0-3 days)", 0, 3), ("2. Standard (4-6 days)", 4, 6))
SPEED_OTHER = "3. Slow (7+ days)"
# Discount bracket labels; upper bounds inclusive, lower exclusive.
NO_DISCOUNT = "1. No discount (0%)"
DISCOUNT_BRACKETS = (("2. Low (1-20%)", "0", "0.2"), ("3. Medium (21-40%)", "0.2", "0.4"))
DISCOUNT_OTHER = "4. High (40%+)"
# Modes held to the ship-day limit in the SLA count.
SLA_MODES = ("Same Day", "First Class")


def ship_mode_performance(
    lines: DataFrame, sla_days: int = 4, sla_modes: Sequence[str] = SLA_MODES
) -> DataFrame:
    """Orders, share of orders, ship-day statistics and SLA-risk lines per mode."""
    days = ship_days()
    per_mode = lines.groupBy("Ship_Mode").agg(
        F.countDistinct("Order_ID").alias("total_orders"),
        round_half_up(mean(days), 2).alias("avg_ship_days"),
        F.min(days).alias("min_ship_days"),
        F.max(days).alias("max_ship_days"),
        count_if((days > sla_days) & F.col("Ship_Mode").isin(*sla_modes)).alias("sla_risk_orders"),
    )
    per_mode = attach_total(per_mode, "total_orders", "_all_orders")
    return per_mode.select(
        "Ship_Mode",
        "total_orders",
        round_half_up(pct("total_orders", "_all_orders"), 1).alias("pct_of_orders"),
        "avg_ship_days",
        "min_ship_days",
        "max_ship_days",
        "sla_risk_orders",
    ).orderBy("avg_ship_days", "Ship_Mode")


def order_level(lines: DataFrame, keys: Sequence[str] = ("Order_ID", "Ship_Mode")) -> DataFrame:
    """One row per order and ship mode: ship days from the earliest dates, sums."""
    return lines.groupBy(*keys).agg(
        day_diff(F.min("Ship_Date"), F.min("Order_Date")).alias("ship_days"),
        F.sum("Sales").alias("order_sales"),
        F.sum("Profit").alias("order_profit"),
    )


def speed_label(days: F.Column, cuts: Sequence[tuple] = SPEED_BUCKETS, other: str = SPEED_OTHER) -> F.Column:
    label = F.lit(other)
    for name, lo, hi in reversed(cuts):
        label = F.when(days.between(lo, hi), F.lit(name)).otherwise(label)
    return label


def speed_vs_margin(lines: DataFrame, cuts: Sequence[tuple] = SPEED_BUCKETS, other: str = SPEED_OTHER) -> DataFrame:
    """Order-level ship speed buckets against value and margin. ``cuts``:
    (label, first day, last day); ``other`` is the label of all further orders."""
    orders = order_level(lines).withColumn("speed_bucket", speed_label(F.col("ship_days"), cuts, other))
    return (
        orders.groupBy("speed_bucket")
        .agg(
            count_rows().alias("order_count"),
            round_half_up(mean("ship_days"), 2).alias("avg_ship_days"),
            round_half_up(mean("order_sales"), 2).alias("avg_order_value"),
            round_half_up(mean("order_profit"), 2).alias("avg_order_profit"),
            margin_pct(F.sum("order_profit"), F.sum("order_sales")).alias("profit_margin_pct"),
            round_half_up(pct(count_if(F.col("order_profit") < 0), count_rows()), 1).alias(
                "pct_loss_making_orders"
            ),
        )
        .orderBy("speed_bucket")
    )


def regional_shipping(
    lines: DataFrame, slow_days: int = 7, mode_by: Sequence[str] = ("Region",)
) -> DataFrame:
    """Order-level ship speed, slowness and margin per (Market, Region).

    The dominant mode is taken over all order rows of the same Region name,
    whatever the market (ties: alphabetically first mode); ``mode_by=("Market",
    "Region")`` takes it per market and region instead.

    Lines become one row per order and mode; the row of an order's first mode counts
    the order, so there is no distinct count. Aggregates per market, region and mode, a
    handful of rows, give the rest: the dominant mode is picked by windows over them.
    Nothing is expanded or collected, and the lines are read once. On lines bucketed
    by Order_ID neither step moves them.
    """
    mode_by = list(mode_by)
    place = ["Market", "Region"]
    shipped = lines.groupBy(*place, "Order_ID", "Ship_Mode").agg(
        day_diff(F.min("Ship_Date"), F.min("Order_Date")).alias("days"),
        F.sum("Sales").alias("sold"),
        F.sum("Profit").alias("gained"),
    )
    modes = Window.partitionBy(*place, "Order_ID").orderBy(F.col("Ship_Mode").asc())
    by_mode = shipped.withColumn("nth", F.row_number().over(modes)).groupBy(*place, "Ship_Mode").agg(
        count_if((F.col("nth") == 1) & F.col("Order_ID").isNotNull()).alias("orders"),
        count_rows().alias("rows"),
        F.count("days").alias("timed"),
        F.sum("days").alias("days"),
        F.max("days").alias("longest"),
        count_if(F.col("days") >= slow_days).alias("slow"),
        F.sum("sold").alias("sold"),
        F.sum("gained").alias("gained"),
    )
    most = F.struct((-F.col("mode_rows")).alias("n"), F.col("Ship_Mode").alias("m"))
    known = F.lit(True)
    for k in mode_by:
        known = known & F.col(k).isNotNull()
    ranked = by_mode.withColumn(
        "mode_rows", F.sum("rows").over(Window.partitionBy(*mode_by, "Ship_Mode"))
    ).withColumn(
        "dominant", F.when(known, F.min_by("Ship_Mode", most).over(Window.partitionBy(*mode_by)))
    )
    return (
        ranked.groupBy(*place)
        .agg(
            F.sum("orders").cast("bigint").alias("total_orders"),
            round_half_up(safe_ratio(F.sum("days"), F.sum("timed")), 2).alias("avg_ship_days"),
            F.max("longest").alias("max_ship_days"),
            round_half_up(pct(F.sum("slow"), F.sum("rows")), 1).alias("pct_slow_orders"),
            margin_pct(F.sum("gained"), F.sum("sold")).alias("profit_margin_pct"),
            F.max("dominant").alias("dominant_ship_mode"),
        )
        .orderBy(F.col("avg_ship_days").desc(), "Market", "Region")
    )


def discount_label(
    d: F.Column, cuts: Sequence[tuple] = DISCOUNT_BRACKETS, none: str = NO_DISCOUNT, other: str = DISCOUNT_OTHER
) -> F.Column:
    label = F.lit(other)
    for name, lo, hi in reversed(cuts):
        label = F.when((d > F.lit(Decimal(str(lo)))) & (d <= F.lit(Decimal(str(hi)))), F.lit(name)).otherwise(label)
    return F.when(d == F.lit(Decimal("0")), F.lit(none)).otherwise(label)


def discount_vs_margin(
    lines: DataFrame, cuts: Sequence[tuple] = DISCOUNT_BRACKETS, none: str = NO_DISCOUNT, other: str = DISCOUNT_OTHER
) -> DataFrame:
    """Line-level discount brackets against margin and loss rate. ``cuts``:
    (label, discount above, discount up to); ``none`` is the label of a discount of
    zero, ``other`` of all further lines."""
    per = lines.groupBy(discount_label(F.col("Discount"), cuts, none, other).alias("discount_bracket")).agg(
        count_rows().alias("order_lines"),
        round_half_up(mean("Discount") * 100, 1).alias("avg_discount_pct"),
        F.sum("Sales").alias("_sales"),
        F.sum("Profit").alias("_profit"),
        round_half_up(mean("Sales"), 2).alias("avg_line_revenue"),
        round_half_up(mean("Profit"), 2).alias("avg_line_profit"),
        count_if(F.col("Profit") < 0).alias("_loss"),
    )
    per = attach_total(per, "order_lines", "_all_lines")
    return per.select(
        "discount_bracket",
        "order_lines",
        round_half_up(pct("order_lines", "_all_lines"), 1).alias("pct_of_lines"),
        "avg_discount_pct",
        money("_sales").alias("total_revenue"),
        money("_profit").alias("total_profit"),
        margin_pct("_profit", "_sales").alias("profit_margin_pct"),
        "avg_line_revenue",
        "avg_line_profit",
        round_half_up(pct("_loss", "order_lines"), 1).alias("pct_loss_making_lines"),
    ).orderBy("discount_bracket")


def heavy_discount_offenders(
    lines: DataFrame, min_discount: str = "0.4", min_lines: int = 20
) -> DataFrame:
    """Product groups with many deeply discounted lines, worst margin first."""
    heavy = lines.where(F.col("Discount") > F.lit(Decimal(str(min_discount))))
    per = heavy.groupBy("Category", "Sub_Category").agg(
        count_rows().alias("discounted_lines"),
        round_half_up(mean("Discount") * 100, 1).alias("avg_discount_pct"),
        money(F.sum("Sales")).alias("revenue"),
        money(F.sum("Profit")).alias("profit"),
        margin_pct(F.sum("Profit"), F.sum("Sales")).alias("profit_margin_pct"),
        round_half_up(pct(count_if(F.col("Profit") < 0), count_rows()), 1).alias("pct_loss_making"),
    )
    return per.where(F.col("discounted_lines") >= min_lines).orderBy(
        F.col("profit_margin_pct").asc(), "Category", "Sub_Category"
    )
