"""Customer analyses (A11-A15): value overview, RFM, concentration, new vs returning.

Per-customer aggregates come from a hash aggregate with map-side combine,
so a customer holding a third of all lines costs one partial row per task.
Whole-base NTILEs go through :func:`salescope.operators.tiles.with_ntiles`,
which finds the first row of each tile instead of sorting the base.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.functions import count_if, count_rows, day_diff, mean, money, pct, round_half_up, safe_ratio
from salescope.operators.common import attach_total, customer_activity_years
from salescope.operators.tiles import TileSpec, with_ntiles
from salescope.plans.session import materialize
from salescope.schema import CUSTOMER_KEYS

# RFM segment labels with the lowest score sum that earns them.
RFM_SEGMENTS = (("Champion", 8), ("Loyal", 6), ("At Risk", 4))
RFM_FALLBACK = "Lost"
RFM_TILES = 3


def customer_sums(lines: DataFrame) -> DataFrame:
    """One row per (Customer_ID, Customer_Name, Segment): latest order date, distinct
    orders and exact spend. Four analyses and an export start from it and take it as
    ``base``; the lines are not read then."""
    return lines.groupBy(*CUSTOMER_KEYS).agg(
        F.max("Order_Date").alias("last_order_date"),
        F.countDistinct("Order_ID").alias("order_count"),
        F.sum("Sales").alias("total_spend"),
    )


def customer_value_overview(lines: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Size of the customer base and per-customer spend statistics."""
    per_customer = customer_sums(lines) if base is None else base
    return per_customer.agg(
        count_rows().alias("total_customers"),
        round_half_up(mean("order_count"), 2).alias("avg_orders_per_customer"),
        round_half_up(mean("total_spend"), 2).alias("avg_lifetime_spend"),
        round_half_up(mean((F.col("total_spend") / F.col("order_count")).cast("decimal(38,10)")), 2).alias("avg_order_value"),
        money(F.min("total_spend")).alias("min_customer_spend"),
        money(F.max("total_spend")).alias("max_customer_spend"),
    )


def rfm_base(lines: DataFrame, as_of: dt.date | str | None = None, base: DataFrame | None = None) -> DataFrame:
    """Per (Customer_ID, Customer_Name, Segment): recency, frequency, spend.

    The per-customer aggregate is materialised once (checkpoint in the
    session's checkpoint folder), unless a written ``base`` of :func:`customer_sums`
    is given. ``as_of=None`` measures recency from the
    latest order date in the data, read from the materialised per-customer
    maxima as a one-row aggregate (broadcast), so the lines are not scanned
    a second time for it.
    """
    base = materialize(customer_sums(lines)) if base is None else base
    base = base.withColumn("total_spend", F.round("total_spend", 2))
    if as_of is None:
        anchor = base.agg(F.max("last_order_date").alias("_as_of"))
        base = base.crossJoin(F.broadcast(anchor))
    else:
        base = base.withColumn("_as_of", F.lit(as_of).cast("date"))
    return base.withColumn("days_since_last_order", day_diff("_as_of", "last_order_date")).drop("_as_of")


def rfm_label(total: F.Column, cuts: Sequence[tuple[str, int]] = RFM_SEGMENTS) -> F.Column:
    """The first label of ``cuts`` whose lowest score sum is reached, else "Lost"."""
    label = F.lit(RFM_FALLBACK)
    for name, floor in sorted(cuts, key=lambda c: c[1]):
        label = F.when(total >= floor, F.lit(name)).otherwise(label)
    return label


def _scored(lines: DataFrame, as_of, tiles: int, cuts, base: DataFrame | None = None, **tile_kw) -> DataFrame:
    if cuts is None:
        if tiles != RFM_TILES:
            raise ValueError(f"the default segment limits are made for {RFM_TILES} tiles; pass cuts for {tiles}")
        cuts = RFM_SEGMENTS
    keys = tuple((k, True) for k in CUSTOMER_KEYS)
    specs = [
        TileSpec(tiles, (("days_since_last_order", False),) + keys, "r_score"),
        TileSpec(tiles, (("order_count", True),) + keys, "f_score"),
        TileSpec(tiles, (("total_spend", True),) + keys, "m_score"),
    ]
    scored = with_ntiles(rfm_base(lines, as_of, base), specs, materialized=True, **tile_kw)
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return scored.withColumn("rfm_total", total).withColumn("rfm_segment", rfm_label(total, cuts))


def rfm_scores(
    lines: DataFrame, as_of=None, tiles: int = RFM_TILES, cuts: Sequence[tuple[str, int]] | None = None, **tile_kw
) -> DataFrame:
    """recency/frequency/monetary tiles and segment per customer.

    ``cuts``: (label, lowest score sum that earns it); needed with other ``tiles``
    than 3, whose score sums go from 3 to 9. ``base``: see :func:`customer_sums`.
    """
    scored = _scored(lines, as_of, tiles, cuts, **tile_kw)
    return scored.select(
        "Customer_ID",
        "Customer_Name",
        F.col("Segment").alias("customer_segment"),
        "last_order_date",
        "days_since_last_order",
        "order_count",
        F.col("total_spend").cast("double").alias("total_spend"),
        "r_score",
        "f_score",
        "m_score",
        "rfm_total",
        "rfm_segment",
    ).orderBy(F.col("rfm_total").desc(), F.col("total_spend").desc(), *CUSTOMER_KEYS)


def rfm_segment_summary(
    lines: DataFrame,
    as_of=None,
    tiles: int = RFM_TILES,
    share_name: str = "pct_of_customers",
    cuts: Sequence[tuple[str, int]] | None = None,
    **tile_kw,
) -> DataFrame:
    """A13 (and E2 with ``share_name='pct_of_base'``): one row per RFM segment."""
    scored = _scored(lines, as_of, tiles, cuts, **tile_kw)
    seg = scored.groupBy("rfm_segment").agg(
        count_rows().alias("customer_count"),
        F.sum("total_spend").alias("_spend"),
        F.count("total_spend").alias("_spend_n"),
        F.sum("order_count").alias("_orders"),
        F.count("order_count").alias("_orders_n"),
        F.sum("days_since_last_order").alias("_days"),
        F.count("days_since_last_order").alias("_days_n"),
    )
    seg = attach_total(seg, "customer_count", "_customers")
    return seg.select(
        "rfm_segment",
        "customer_count",
        round_half_up(pct("customer_count", "_customers"), 1).alias(share_name),
        round_half_up(safe_ratio("_spend", "_spend_n"), 2).alias("avg_lifetime_spend"),
        round_half_up(safe_ratio("_orders", "_orders_n"), 2).alias("avg_orders"),
        round_half_up(safe_ratio("_days", "_days_n"), 0).alias("avg_days_since_last_order"),
    ).orderBy(F.col("avg_lifetime_spend").desc(), "rfm_segment")


def revenue_concentration(lines: DataFrame, tiles: int = 5, base: DataFrame | None = None, **tile_kw) -> DataFrame:
    """Revenue per spend tile of customers (tile ``tiles`` = top spenders).
    ``base``: see :func:`customer_sums`; its sums are exact, so they add up."""
    if base is None:
        spend = lines.groupBy("Customer_ID").agg(F.sum("Sales").alias("total_spend"))
    else:
        spend = base.groupBy("Customer_ID").agg(F.sum("total_spend").alias("total_spend"))
    spec = TileSpec(tiles, (("total_spend", True), ("Customer_ID", True)), "spend_quintile")
    tiled = with_ntiles(spend, [spec], **tile_kw)
    per_tile = tiled.groupBy("spend_quintile").agg(
        count_rows().alias("customers"),
        F.sum("total_spend").alias("_rev"),
        F.count("total_spend").alias("_n"),
        F.min("total_spend").alias("_min"),
        F.max("total_spend").alias("_max"),
    )
    per_tile = attach_total(per_tile, "_rev", "_all_rev")
    return per_tile.select(
        "spend_quintile",
        "customers",
        money("_rev").alias("quintile_revenue"),
        round_half_up(pct("_rev", "_all_rev"), 1).alias("pct_of_total_revenue"),
        round_half_up(safe_ratio("_rev", "_n"), 2).alias("avg_spend_per_customer"),
        money("_min").alias("min_spend"),
        money("_max").alias("max_spend"),
    ).orderBy(F.col("spend_quintile").desc())


def new_vs_returning(lines: DataFrame) -> DataFrame:
    """Per active year, customers in their first year vs returning ones."""
    act = customer_activity_years(lines)
    is_new = F.col("active_year") == F.col("cohort_year")
    return (
        act.groupBy(F.col("active_year").alias("year"))
        .agg(
            count_if(is_new).alias("new_customers"),
            count_if(~is_new | is_new.isNull()).alias("returning_customers"),
            count_rows().alias("total_active_customers"),
        )
        .withColumn(
            "pct_new",
            round_half_up(pct("new_customers", "total_active_customers"), 1),
        )
        .orderBy("year")
    )
