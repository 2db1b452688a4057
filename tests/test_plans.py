"""Plan shape: no analysis moves unaggregated lines into one task, filters
and column pruning reach the Parquet scan of the store, and the decorrelated
dominant mode plans as joins, not a subquery."""

import os

import pytest

from salescope.plans.registry import ANALYSES
from salescope.sources.star import order_lines
from salescope.sources.store import build_store_from_star, read_order_store

AGGREGATES = {"HashAggregate", "SortAggregate", "ObjectHashAggregate"}


def _children(node):
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def _raw_lines_below(node) -> bool:
    """True if a path from ``node`` reaches a lineitem scan with no aggregate."""
    name = node.nodeName()
    if name in AGGREGATES:
        return False
    if "Scan" in name and "lineitem" in node.toString():
        return True
    return any(_raw_lines_below(c) for c in _children(node))


def _single_partition_exchanges(node):
    found = []
    if node.nodeName() == "Exchange" and "SinglePartition" in node.toString().split("\n")[0]:
        found.append(node)
    for c in _children(node):
        found += _single_partition_exchanges(c)
    return found


@pytest.fixture(scope="module")
def no_aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_no_single_partition_exchange_over_raw_lines(no_aqe, sf_dir, name):
    df = ANALYSES[name](order_lines(no_aqe, sf_dir))
    plan = df._jdf.queryExecution().executedPlan()
    for ex in _single_partition_exchanges(plan):
        assert not _raw_lines_below(ex), f"{name}: {ex.toString()[:300]}"


@pytest.fixture(scope="module")
def store(spark, sf_dir, scratch_dir):
    path = os.path.join(scratch_dir, "store")
    build_store_from_star(spark, sf_dir, path)
    return path


def _formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_filter_pushed_and_columns_pruned(spark, store):
    from salescope.operators.shipping import heavy_discount_offenders

    plan = _formatted(heavy_discount_offenders(read_order_store(spark, store)))
    assert "PushedFilters: [IsNotNull(Discount), GreaterThan(Discount,0.4000)]" in plan
    schema_line = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    for c in ("Category", "Sub_Category", "Discount", "Sales", "Profit"):
        assert c in schema_line
    for c in ("Customer_ID", "Order_Date", "Ship_Mode", "Region"):
        assert c not in schema_line


def test_store_answers_equal_star_answers(spark, sf_dir, store):
    lines = read_order_store(spark, store)
    for name in ("region_pnl", "rfm_segment_summary", "cohort_retention", "regional_shipping"):
        a = sorted(tuple(r) for r in ANALYSES[name](lines).collect())
        b = sorted(tuple(r) for r in ANALYSES[name](order_lines(spark, sf_dir)).collect())
        assert a == b, name


def test_year_filter_prunes_partitions(spark, store):
    from pyspark.sql import functions as F

    df = read_order_store(spark, store, keep_year=True).where(F.col("order_year") == 1996)
    plan = _formatted(df)
    assert "PartitionFilters: [isnotnull(order_year" in plan


def test_dominant_mode_is_decorrelated(spark, sf_dir):
    from salescope.operators.shipping import regional_shipping

    plan = _formatted(regional_shipping(order_lines(spark, sf_dir)))
    assert "Subquery" not in plan
    assert "Expand" not in plan and "Window" in plan


def _order_years_exchanges(spark, sf_dir, name):
    plan = ANALYSES[name](order_lines(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    return plan.count("hashpartitioning(Customer_ID#")


@pytest.mark.parametrize("name", ["new_vs_returning", "cohort_retention"])
def test_one_exchange_per_customer(no_aqe, sf_dir, name):
    assert _order_years_exchanges(no_aqe, sf_dir, name) == 1


def test_fact_is_shuffled_once_by_order_and_once_by_part(no_aqe, sf_dir):
    no_aqe.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = order_lines(no_aqe, sf_dir)._jdf.queryExecution().executedPlan()
    finally:
        no_aqe.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def count(node):
        own = node.nodeName() == "Exchange" and "lineitem" in node.toString()
        return own + sum(count(c) for c in _children(node))

    assert count(plan) == 2


def test_new_files_are_seen(spark, sf_dir, tmp_path):
    import shutil

    from salescope.plans.registry import star_queries

    for t in ("lineitem", "orders", "customer", "nation", "region", "part"):
        os.makedirs(tmp_path / f"{t}.parquet")
        shutil.copy(os.path.join(sf_dir, f"{t}.parquet"), tmp_path / f"{t}.parquet" / "a.parquet")
    query = star_queries()["dataset_shape"]
    once = query(spark, str(tmp_path)).first()["total_rows"]
    shutil.copy(os.path.join(sf_dir, "lineitem.parquet"), tmp_path / "lineitem.parquet" / "b.parquet")
    assert query(spark, str(tmp_path)).first()["total_rows"] == 2 * once


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_lines_are_read_once(no_aqe, sf_dir, name):
    """No analysis joins and scans the fact table twice (a differently pruned
    second branch over the same aggregate would)."""
    plan = ANALYSES[name](order_lines(no_aqe, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") <= 1, name


def test_detector_flags_a_window_over_raw_lines(no_aqe, sf_dir):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    bad = order_lines(no_aqe, sf_dir).withColumn("rn", F.row_number().over(Window.orderBy("Row_ID")))
    exchanges = _single_partition_exchanges(bad._jdf.queryExecution().executedPlan())
    assert exchanges and any(_raw_lines_below(ex) for ex in exchanges)
