"""Trends (A16-A19): month-over-month growth, rolling means, ranks, running totals.

All windows run over the monthly aggregate or over product x geography
groups, never over lines. LAG, LEAD and framed sums sharing one ordering
are evaluated by a single Window operator after a single sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions import count_rows, margin_pct, money, pct, round_half_up
from salescope.operators.common import attach_total, monthly_base
from salescope.operators.ranges import with_rank, with_running_sums
from salescope.operators.profitability import growth_pct, trailing_mean
from salescope.plans.session import materialize
from salescope.schema import BOUNDED_COLUMNS


def mom_growth(lines: DataFrame, calendar: bool = False, base: DataFrame | None = None) -> DataFrame:
    """Monthly revenue with previous month and growth %.

    ``calendar=True`` compares with the previous calendar month (a month
    without orders counts as revenue 0) instead of the previous row.
    """
    m = monthly_base(lines, calendar, base)
    prev = F.lag("sales").over(Window.orderBy(F.col("yr_mo").asc()))
    return m.select(
        "yr_mo",
        F.col("yr").alias("year"),
        F.col("mo").alias("month"),
        money("sales").alias("revenue"),
        "orders",
        money(prev).alias("prev_month_revenue"),
        round_half_up(growth_pct("sales", prev), 2).alias("mom_growth_pct"),
    ).orderBy("yr_mo")


MEASURES = {"revenue": "sales", "profit": "profit_sum", "orders": "orders", "lines": "lines"}


def rolling_average(
    lines: DataFrame, months: int = 3, measures: Sequence[str] = ("revenue", "profit"), base: DataFrame | None = None
) -> DataFrame:
    """Monthly revenue and profit with trailing means over ``months`` rows of
    each of ``measures`` (revenue, profit, orders, lines)."""
    unknown = [x for x in measures if x not in MEASURES]
    if unknown:
        raise ValueError(f"unknown measures {unknown}; known are {list(MEASURES)}")
    m = monthly_base(lines, base=base)
    return m.select(
        "yr_mo",
        money("sales").alias("revenue"),
        money("profit_sum").alias("profit"),
        margin_pct("profit_sum", "sales").alias("margin_pct"),
        *[
            round_half_up(trailing_mean(MEASURES[x], "yr_mo", months), 2).alias(f"rolling_{months}mo_{x}")
            for x in measures
        ],
    ).orderBy("yr_mo")


def revenue_leaderboard(
    lines: DataFrame,
    partition: Sequence[str] = ("Region",),
    by: Sequence[str] = ("Region", "Market", "Category", "Sub_Category"),
) -> DataFrame:
    """Rank of each product group within its region and overall.

    Revenue and profit are rounded before ranking, as in the statement. The
    in-region rank partitions by ``partition`` only (Region by default, so
    same-named regions of different markets share one leaderboard).
    ``by`` are any columns that include those of ``partition``. Groups whose number
    the dimensions bound are ranked by windows; others (by product, by customer) are
    written first and ranked by counts over ranges of revenue, not in one task.
    """
    by, partition = list(by), list(partition)
    if not set(partition) <= set(by):
        raise ValueError(f"partition {partition} is not part of by {by}")
    shown = [c for c in ("Market", "Region", "Category", "Sub_Category") if c in by]
    shown += [c for c in by if c not in shown]
    groups = lines.groupBy(*by).agg(
        F.round(F.sum("Sales"), 2).alias("_rev"),
        F.round(F.sum("Profit"), 2).alias("_prof"),
        count_rows().alias("order_lines"),
    )
    if set(by) <= BOUNDED_COLUMNS:
        highest = F.col("_rev").desc()
        ranked = groups.withColumn("_here", F.rank().over(Window.partitionBy(*partition).orderBy(highest))).withColumn(
            "_all", F.rank().over(Window.orderBy(highest))
        )
    else:
        ranked = with_rank(with_rank(materialize(groups), "_rev", "_here", within=partition), "_rev", "_all")
    return ranked.select(
        *shown,
        F.col("_rev").cast("double").alias("revenue"),
        F.col("_prof").cast("double").alias("profit"),
        margin_pct("_prof", "_rev").alias("margin_pct"),
        "order_lines",
        F.col("_here").cast("bigint").alias("revenue_rank_in_region"),
        F.col("_all").cast("bigint").alias("global_revenue_rank"),
    ).orderBy(*partition, "revenue_rank_in_region", *[c for c in shown if c not in partition])


def running_total(lines: DataFrame, by: str | None = None, base: DataFrame | None = None) -> DataFrame:
    """Cumulative revenue and profit by month and share of the grand total.

    ``by`` takes any other column instead of months (``Order_Date`` for days,
    ``Customer_ID``); its groups, in their order with NULL first, are written and summed
    over ranges of it, not in one task.
    """
    if by is not None:
        groups = materialize(
            lines.groupBy(by).agg(
                F.sum("Sales").alias("_sales"), F.sum("Profit").alias("_profit"), F.countDistinct("Order_ID").alias("orders")
            )
        )
        summed = with_running_sums(groups, [(by, True)], {"_upto": "_sales", "_profit_upto": "_profit"})
        grand = groups.agg(F.sum("_sales").alias("_grand"))
        return summed.crossJoin(F.broadcast(grand)).select(
            by,
            money("_sales").alias("revenue"),
            money("_upto").alias("cumulative_revenue"),
            round_half_up(pct("_upto", "_grand"), 2).alias("cumulative_pct_of_total"),
            money("_profit_upto").alias("cumulative_profit"),
            "orders",
        ).orderBy(by)
    m = attach_total(monthly_base(lines, base=base), "sales", "_grand")
    upto = Window.orderBy(F.col("yr_mo").asc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum("sales").over(upto)
    return m.select(
        "yr_mo",
        F.col("yr").alias("year"),
        money("sales").alias("monthly_revenue"),
        money(cum).alias("cumulative_revenue"),
        round_half_up(pct(cum, "_grand"), 2).alias("cumulative_pct_of_total"),
        money(F.sum("profit_sum").over(upto)).alias("cumulative_profit"),
        "orders",
    ).orderBy("yr_mo")
