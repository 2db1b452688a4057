"""The versioned store (staged refresh, one switch) and its clustered layout."""

import os

import pytest
from pyspark.sql import functions as F

from salescope.plans.registry import ANALYSES
from salescope.schema import ORDER_LINE_SCHEMA
from salescope.sources import store as st
from salescope.sources import versions as vs
from salescope.sources.star import order_lines

BY_ORDER = ("ship_mode_performance", "speed_vs_margin", "regional_shipping")


def lines_of(spark, n, sales=1):
    return spark.range(n).select(
        F.col("id").alias("Row_ID"),
        F.concat(F.lit("O-"), F.col("id") % 7).alias("Order_ID"),
        F.date_add(F.lit("2011-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("Order_Date"),
        F.lit(sales).cast("decimal(18,4)").alias("Sales"),
    )


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "store")


def total(df):
    return tuple(df.agg(F.count("*"), F.sum("Sales")).first())


def test_reader_of_the_old_version_finishes_after_the_switch(spark, folder):
    before = st.refresh_order_store(spark, lines_of(spark, 50), folder)
    planned = before.groupBy("Order_ID").agg(F.sum("Sales").alias("s"))
    after = st.refresh_order_store(spark, lines_of(spark, 80, 2), folder)
    assert total(before) == (50, 50) and total(after) == (80, 160)
    assert planned.agg(F.sum("s")).first()[0] == 50
    assert total(st.read_order_store(spark, folder)) == (80, 160)


def test_killed_write_leaves_the_old_store_whole(spark, folder):
    st.refresh_order_store(spark, lines_of(spark, 50), folder)

    def half(new):
        lines_of(spark, 10).write.parquet(new)  # files are there, the write does not end
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        vs.refresh(spark, folder, half)
    broken = lines_of(spark, 50).withColumn("Sales", F.raise_error(F.lit("bad line")).cast("decimal(18,4)"))
    with pytest.raises(Exception, match="bad line"):
        st.refresh_order_store(spark, broken, folder)
    assert total(st.read_order_store(spark, folder)) == (50, 50)
    assert len(vs.published_versions(spark, folder)) == 1
    assert vs.clear_unpublished(spark, folder) >= 1
    assert total(st.read_order_store(spark, folder)) == (50, 50)
    after = st.refresh_order_store(spark, lines_of(spark, 5), folder)
    assert total(after) == (5, 5)


def test_reader_during_a_refresh_sees_the_old_store(spark, folder):
    st.refresh_order_store(spark, lines_of(spark, 50), folder)
    seen = []

    def write(new):
        lines_of(spark, 80).write.parquet(new)
        seen.append(total(st.read_order_store(spark, folder)))

    vs.refresh(spark, folder, write)
    assert seen == [(50, 50)]
    assert total(st.read_order_store(spark, folder)) == (80, 80)


def test_refresh_from_the_store_itself_and_roll_back(spark, folder):
    st.refresh_order_store(spark, lines_of(spark, 50), folder)
    st.refresh_order_store(spark, st.read_order_store(spark, folder).where("Row_ID < 20"), folder)
    assert total(st.read_order_store(spark, folder)) == (20, 20)
    vs.roll_back(spark, folder)
    assert total(st.read_order_store(spark, folder)) == (50, 50)
    with pytest.raises(ValueError):
        vs.roll_back(spark, folder)


def test_only_the_newest_versions_are_kept(spark, folder):
    for n in range(1, 5):
        st.refresh_order_store(spark, lines_of(spark, n), folder, keep=2)
    names = vs.published_versions(spark, folder)
    assert [int(n[1:9]) for n in names] == [3, 4]
    assert sorted(x for x in os.listdir(folder) if x.startswith("v")) == names
    with pytest.raises(ValueError):
        st.refresh_order_store(spark, lines_of(spark, 1), folder, keep=0)


def test_a_plain_table_is_a_store(spark, folder):
    from salescope.sources.csv_ingest import write_order_lines

    write_order_lines(lines_of(spark, 30), folder)
    assert vs.current_version(spark, folder) is None
    assert total(st.read_order_store(spark, folder)) == (30, 30)


def test_staged_ingest_makes_versions(spark, tmp_path):
    from salescope.sources.csv_ingest import ingest_order_csv

    csv, out = tmp_path / "in.csv", str(tmp_path / "store")
    csv.write_text("Row ID,Order ID,Order Date,Sales\n1,A,1-1-2011,2.5\n", encoding="latin-1")
    old = ingest_order_csv(spark, str(csv), out_path=out, staged=True).lines
    csv2 = tmp_path / "in2.csv"
    csv2.write_text("Row ID,Order ID,Order Date,Sales\n1,A,1-1-2011,2.5\n2,B,1-1-2012,4\n", encoding="latin-1")
    new = ingest_order_csv(spark, str(csv2), out_path=out, staged=True).lines
    assert (old.count(), new.count(), st.read_order_store(spark, out).count()) == (1, 2, 2)
    assert len(vs.published_versions(spark, out)) == 2


@pytest.fixture(scope="module")
def clustered(spark, sf_dir, scratch_dir):
    yield st.refresh_clustered_store(spark, order_lines(spark, sf_dir), os.path.join(scratch_dir, "it's clustered"), 8)
    assert st.release_store_tables(spark) >= 1


def exchanges(node):
    """The first line of every shuffle of the plan."""
    kids = node.children()
    below = [x for i in range(kids.size()) for x in exchanges(kids.apply(i))]
    return ([node.toString().split("\n")[0]] if node.nodeName() == "Exchange" else []) + below


@pytest.mark.parametrize("name", BY_ORDER)
def test_clustered_store_moves_no_lines_by_order(spark, sf_dir, clustered, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = ANALYSES[name](clustered)
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Bucketed: true" in plan.toString()
    assert not [x for x in exchanges(plan) if "Order_ID" in x]
    by_star = ANALYSES[name](order_lines(spark, sf_dir))
    assert sorted(map(str, df.collect())) == sorted(map(str, by_star.collect()))


def test_year_store_does_move_them(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = ANALYSES["speed_vs_margin"](st.build_store_from_star(spark, sf_dir, str(tmp_path / "years")))
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [x for x in exchanges(plan) if "Order_ID" in x]


def test_clustered_store_prunes_years(clustered, spark, scratch_dir):
    df = st.read_order_store(spark, os.path.join(scratch_dir, "it's clustered"), keep_year=True)
    plan = df.where("order_year = 1996")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan


def test_clustered_store_keeps_null_keys_dates_and_other_columns(spark, folder):
    rows = [(1, None, None, "a"), (2, None, "2011-05-01", "b"), (3, "O-1", None, None), (4, "O-1", "2012-01-01", "c")]
    lines = spark.createDataFrame(rows, "Row_ID long, Order_ID string, d string, `my note` string").select(
        "Row_ID", "Order_ID", F.col("d").cast("date").alias("Order_Date"), "my note"
    )
    got = st.refresh_clustered_store(spark, lines, folder, 3)
    want = sorted(map(str, lines.collect()))
    assert sorted(map(str, got.select(*lines.columns).collect())) == want
    # the other layout follows in the same folder, and readers take it
    after = st.refresh_order_store(spark, lines.where("Row_ID > 2"), folder)
    assert after.count() == 2 and got.count() == 4
    with pytest.raises(ValueError):
        st.refresh_clustered_store(spark, lines, folder, 0)


def test_all_order_line_columns_survive(spark, clustered):
    assert set(clustered.columns) == {f.name for f in ORDER_LINE_SCHEMA.fields}
    assert {f.name: f.dataType for f in clustered.schema.fields} == {f.name: f.dataType for f in ORDER_LINE_SCHEMA.fields}
