"""Building blocks shared by several analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions import count_rows, month_text, year_month_text, year_text


def attach_total(df: DataFrame, col: str, alias: str) -> DataFrame:
    """Add the grand total of ``col`` over all rows of an aggregated ``df``.

    A window over the whole (already aggregated) result, so the upstream
    plan runs once: a second branch computing the total would be pruned
    differently and Spark would scan and join the lines twice. Use it on
    results whose row count is bounded by a dimension (categories, brackets,
    modes, segments, tiles, months), never on lines.
    """
    return df.withColumn(alias, F.sum(col).over(Window.partitionBy()))


def month_sums(lines: DataFrame) -> DataFrame:
    """One row per month of the lines: what :func:`monthly_base` is made of."""
    return lines.groupBy(F.trunc("Order_Date", "month").alias("_month")).agg(
        F.sum("Sales").alias("sales"),
        F.sum("Profit").alias("profit_sum"),
        F.countDistinct("Order_ID").alias("orders"),
        count_rows().alias("lines"),
    )


def monthly_base(lines: DataFrame, calendar: bool = False, base: DataFrame | None = None) -> DataFrame:
    """One row per year-month: exact DECIMAL sums and distinct orders. ``base`` is
    :func:`month_sums` of the lines where it is at hand; the lines are not read then.

    Lines are grouped on the first day of their month (a DATE, cheap to hash
    and compare); the text keys are formatted once per month afterwards.
    Shared by the monthly trend, growth, rolling, running-total and
    same-month analyses; Catalyst prunes the aggregates a caller does not use.

    ``calendar=True`` adds the months without any order between the first and
    the last one (sums 0, counts 0), so that row offsets are calendar offsets.
    Each present month emits itself and the empty months up to the next
    present one, so no second pass or join over the months is needed.
    """
    months = month_sums(lines) if base is None else base
    if calendar:
        months = months.withColumn("_next", F.lead("_month").over(Window.orderBy(F.col("_month").asc())))
        nxt = F.col("_next")
        gap_end = F.when(
            F.col("_month").isNotNull() & nxt.isNotNull(), F.add_months(nxt, -1)
        ).otherwise(F.col("_month"))
        span = F.when(
            F.col("_month").isNotNull(),
            F.sequence(F.col("_month"), gap_end, F.expr("INTERVAL 1 MONTH")),
        ).otherwise(F.array(F.col("_month")))
        filled = months.select("*", F.posexplode(span).alias("_pos", "_m")).drop("_next")
        present = F.col("_pos") == 0
        months = filled.select(
            F.col("_m").alias("_month"),
            *[
                F.when(present, F.col(c)).otherwise(F.lit(0).cast(months.schema[c].dataType)).alias(c)
                for c in ("sales", "profit_sum", "orders", "lines")
            ],
        )
    return months.select(
        year_month_text("_month").alias("yr_mo"),
        year_text("_month").alias("yr"),
        month_text("_month").alias("mo"),
        "sales",
        "profit_sum",
        "orders",
        "lines",
    )


def customer_activity_years(lines: DataFrame) -> DataFrame:
    """Distinct (Customer_ID, active year) pairs with the customer's first year.

    Years are keyed as DATEs (first of January) and formatted at the end.
    One aggregate per customer collects the set of years, which the calendar
    bounds, with map-side combine: a customer holding a third of all lines sends
    one small set per task, and first year and active years come from the same
    single exchange, without a sort. Lines without a date make one pair with a
    NULL year. Customers with NULL id are dropped.
    """
    per_customer = (
        lines.where(F.col("Customer_ID").isNotNull())
        .groupBy("Customer_ID")
        .agg(
            F.collect_set(F.trunc("Order_Date", "year")).alias("_years"),
            F.bool_or(F.col("Order_Date").isNull()).alias("_undated"),
        )
    )
    undated = F.when(F.col("_undated"), F.array(F.lit(None).cast("date"))).otherwise(F.array().cast("array<date>"))
    return per_customer.select(
        "Customer_ID",
        F.explode(F.concat("_years", undated)).alias("_year"),
        F.array_min("_years").alias("_first"),
    ).select(
        "Customer_ID",
        year_text("_year").alias("active_year"),
        year_text("_first").alias("cohort_year"),
    )
