"""Every registered analysis against its DuckDB oracle on the star tables."""

import pytest

import __spark_entry__ as entry_mod
from oracle_compare import compare, duck
from salescope.plans.registry import ANALYSES

NAMES = sorted(ANALYSES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_oracle():
    assert set(NAMES) <= set(entry_mod.queries()) & set(entry_mod.oracle_sql())
    assert len(NAMES) == 31


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = entry_mod.queries()[name](spark, sf_dir)
    problems = compare(df, con, entry_mod.oracle_sql()[name])
    assert not problems, problems


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["Market", "Region"]
