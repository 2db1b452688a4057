"""Shared bases: same results as one by one, lines read once for each base, nothing
left behind."""

import os

import pytest

from salescope.operators import bases as b
from salescope.operators import trends
from salescope.plans.registry import ANALYSES
from salescope.plans.session import checkpoint_dir, materialize, materialized_scope
from salescope.sources.star import order_lines

SHARED = sorted(n for n, f in ANALYSES.items() if f in b.BY_MONTH | b.BY_CUSTOMER)


def test_eleven_analyses_share():
    assert len(SHARED) == len(b.BY_MONTH) + len(b.BY_CUSTOMER) == 11


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return order_lines(spark, sf_dir)


@pytest.fixture(scope="module")
def shared(lines):
    with b.shared_bases(lines) as bases:
        yield bases


@pytest.mark.parametrize("name", SHARED)
def test_same_rows_and_no_scan_of_the_lines(spark, lines, shared, name):
    df = shared.run(ANALYSES[name])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
    alone = ANALYSES[name](lines)
    assert df.schema.simpleString() == alone.schema.simpleString()
    assert sorted(map(str, df.collect())) == sorted(map(str, alone.collect()))


def test_each_base_is_written_once(lines):
    with b.shared_bases(lines) as bases:
        assert bases.months() is bases.months() and bases.customers() is bases.customers()
        by_day = bases.run(trends.running_total, by="Order_Date")
        assert by_day.columns[0] == "Order_Date"
        assert bases.run(trends.mom_growth, calendar=True).count() >= bases.run(trends.mom_growth).count()


def test_reports_are_written_and_bases_removed(spark, lines, tmp_path):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    names = ["mom_growth", "running_total", "rfm_segment_summary", "revenue_concentration", "dataset_shape"]
    manifest = {r["name"]: r for r in b.write_reports(lines, str(tmp_path), ANALYSES, names).collect()}
    assert sorted(manifest) == sorted(names)
    assert set(os.listdir(folder)) == before
    for name, row in manifest.items():
        assert spark.read.parquet(row["path"]).count() == row["rows"] > 0, name
    with pytest.raises(ValueError):
        b.write_reports(lines, str(tmp_path), ANALYSES, ["nothing"])


def test_scope_frees_its_own_only_also_after_an_error(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    outer = materialize(spark.range(3))
    before = set(os.listdir(folder))
    with pytest.raises(RuntimeError), materialized_scope(spark):
        assert materialize(spark.range(4)).count() == 4
        assert len(set(os.listdir(folder)) - before) == 1
        raise RuntimeError
    assert set(os.listdir(folder)) == before and outer.count() == 3


def test_no_lines(spark, lines):
    none = lines.where("1 = 0")
    with b.shared_bases(none) as bases:
        for name in SHARED:
            assert sorted(map(str, bases.run(ANALYSES[name]).collect())) == sorted(map(str, ANALYSES[name](none).collect())), name
