"""Cohorts (A25-A27) and same-month comparison.

A customer's cohort is the year of their earliest non-NULL order date. The
retention matrix is built from distinct (customer, year) pairs alone: the
first year is the minimum over a customer's pairs, so the statement's join
of first orders with activity disappears. The cohort value analysis gets
first date, spend and distinct orders from one per-customer aggregate, which
replaces the statement's self-join of the base table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions import count_if, count_rows, mean, money, pct, round_half_up, year_month_text, year_text
from salescope.operators.common import customer_activity_years, monthly_base
from salescope.operators.profitability import growth_pct, trailing_mean
from salescope.operators.ranges import with_percent_rank
from salescope.plans.session import materialize


def cohort_retention(lines: DataFrame, horizon: int = 3) -> DataFrame:
    """Customers of each first-order year still active 0..horizon years later."""
    act = customer_activity_years(lines).where(F.col("cohort_year").isNotNull())
    gap = F.col("active_year").cast("int") - F.col("cohort_year").cast("int")
    per = act.groupBy("cohort_year").agg(
        *[count_if(gap == k).alias(f"yr{k}_customers") for k in range(horizon + 1)]
    )
    cols = [
        "cohort_year",
        F.col("yr0_customers").alias("cohort_size"),
        "yr0_customers",
    ]
    for k in range(1, horizon + 1):
        cols.append(f"yr{k}_customers")
        cols.append(round_half_up(pct(f"yr{k}_customers", "yr0_customers"), 1).alias(f"yr{k}_retention_pct"))
    return per.select(*cols).orderBy("cohort_year")


def same_month_yoy(
    lines: DataFrame, lag: int = 12, trailing: int = 12, calendar: bool = False, base: DataFrame | None = None
) -> DataFrame:
    """Revenue against the row ``lag`` months back and ahead.

    Offsets count rows of the monthly series, not calendar months, as the
    statement does; monthly figures are rounded to cents first.
    ``calendar=True`` first adds the months without orders, so the offsets
    are calendar months.
    """
    m = monthly_base(lines, calendar, base).select(
        "yr_mo",
        "yr",
        "mo",
        F.round("sales", 2).alias("_rev"),
        F.round("profit_sum", 2).alias("_prof"),
        "orders",
    )
    w = Window.orderBy(F.col("yr_mo").asc())
    before = F.lag("_rev", lag).over(w)
    return m.select(
        "yr_mo",
        F.col("yr").alias("year"),
        F.col("mo").alias("month"),
        F.col("_rev").cast("double").alias("revenue"),
        F.col("_prof").cast("double").alias("profit"),
        "orders",
        money(before).alias("same_month_last_year"),
        round_half_up(growth_pct("_rev", before), 2).alias("yoy_same_month_growth_pct"),
        money(F.lead("_rev", lag).over(w)).alias("same_month_next_year"),
        round_half_up(trailing_mean("_rev", "yr_mo", trailing), 2).alias(f"trailing_{trailing}mo_avg"),
    ).orderBy("yr_mo")


#: Cohort keys of a customer, from the earliest order date: name and column.
COHORT_PERIODS = {"year": ("cohort_year", year_text), "month": ("cohort_month", year_month_text), "day": ("cohort_day", F.col)}


def cohort_value(lines: DataFrame, period: str = "year", by: Sequence[str] = ()) -> DataFrame:
    """Spend and orders per customer, averaged per cohort, and the rank of
    each cohort's average among all cohorts (PERCENT_RANK over cohorts).

    Cohorts are of the first order's ``period`` (year, month, day) and of ``by``, columns
    that a customer has one value of (the least, if there are several). The ranking of
    years is a window over one row a year; other cohorts are written and ranked by counts
    over ranges of the average, not in one task.
    """
    name, text = COHORT_PERIODS[period]
    by = list(by)
    per_customer = (
        lines.where(F.col("Customer_ID").isNotNull())
        .groupBy("Customer_ID")
        .agg(
            F.min("Order_Date").alias("_first"),
            *[F.min(c).alias(c) for c in by],
            F.round(F.sum("Sales"), 2).alias("lifetime_spend"),
            F.countDistinct("Order_ID").alias("total_orders"),
        )
    )
    per_cohort = per_customer.groupBy(text("_first").alias(name), *by).agg(
        count_rows().alias("cohort_size"),
        mean("lifetime_spend").alias("_avg_spend"),
        round_half_up(mean("total_orders"), 2).alias("avg_orders"),
        money(F.min("lifetime_spend")).alias("min_spend"),
        money(F.max("lifetime_spend")).alias("max_spend"),
    )
    if period == "year" and not by:
        # one row per cohort year: the ranking window is bounded by the calendar
        ranked = per_cohort.withColumn("_rank", F.percent_rank().over(Window.orderBy(F.col("_avg_spend").asc())))
    else:
        ranked = with_percent_rank(materialize(per_cohort), "_avg_spend", "_rank")
    return ranked.select(
        name,
        *by,
        "cohort_size",
        round_half_up("_avg_spend", 2).alias("avg_lifetime_spend"),
        "avg_orders",
        "min_spend",
        "max_spend",
        round_half_up(F.col("_rank") * 100, 1).alias("spend_percentile"),
    ).orderBy(name, *by)
