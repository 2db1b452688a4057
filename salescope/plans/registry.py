"""Name -> analysis registry used by the driver entry points, the benchmark
and the batch export. Every entry reads the star tables of ``sf_dir``
through :func:`salescope.sources.star.order_lines`, so its work grows with
the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salescope.operators import cohorts, customers, exports, profile, profitability, shipping, trends
from salescope.plans.oracle import ORACLE_SQL
from salescope.sources.star import order_lines

Analysis = Callable[[DataFrame], DataFrame]

ANALYSES: dict[str, Analysis] = {
    # profiling
    "dataset_shape": profile.dataset_shape,
    "date_coverage": profile.date_coverage,
    "cardinality": profile.cardinality,
    "null_audit": profile.null_audit,
    "category_mix": profile.category_mix,
    # revenue and profitability
    "annual_summary": profitability.annual_summary,
    "region_pnl": profitability.region_pnl,
    "top_margin": profitability.top_margin,
    "bottom_margin": profitability.bottom_margin,
    "monthly_trend": profitability.monthly_trend,
    # customers
    "customer_value_overview": customers.customer_value_overview,
    "rfm_scores": customers.rfm_scores,
    "rfm_segment_summary": customers.rfm_segment_summary,
    "revenue_concentration": customers.revenue_concentration,
    "new_vs_returning": customers.new_vs_returning,
    # trends
    "mom_growth": trends.mom_growth,
    "rolling_average": trends.rolling_average,
    "revenue_leaderboard": trends.revenue_leaderboard,
    "running_total": trends.running_total,
    # shipping and discounting
    "ship_mode_performance": shipping.ship_mode_performance,
    "speed_vs_margin": shipping.speed_vs_margin,
    "regional_shipping": shipping.regional_shipping,
    "discount_vs_margin": shipping.discount_vs_margin,
    "heavy_discount_offenders": shipping.heavy_discount_offenders,
    # cohorts
    "cohort_retention": cohorts.cohort_retention,
    "same_month_yoy": cohorts.same_month_yoy,
    "cohort_value": cohorts.cohort_value,
    # exports
    "export_revenue_by_region": exports.export_revenue_by_region,
    "export_rfm_segment_summary": exports.export_rfm_segment_summary,
    "export_monthly_mom_growth": exports.export_monthly_mom_growth,
    "export_ship_mode_breakdown": exports.export_ship_mode_breakdown,
}


def _bind(fn: Analysis) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(order_lines(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def star_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for name, fn in ANALYSES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: ORACLE_SQL[name] for name in ANALYSES if name in ORACLE_SQL}
