"""Running sums, ranks and totals by ranges equal Spark's unpartitioned windows, and
plan no exchange of the rows into one task."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from salescope.operators import ranges as rg

SCHEMA = "k string, g string, v decimal(28,4), n bigint, d date, x double"


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        v = None if i % 17 == 5 else Decimal(7) if hot else Decimal(rng.randint(-10**9, 10**9)) / 10000
        day = None if i % 23 == 4 else dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(-400, 400))
        out.append((f"k{i:05d}é" if i else None, rng.choice(["a", "b", None]), v, rng.choice([None, 1, 2, 10**15]), day, rng.uniform(-5, 5)))
    return out


@pytest.fixture(scope="module")
def table(spark, scratch_dir):
    path = f"{scratch_dir}/ranges"
    spark.createDataFrame(rows(1500), SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("ranges", [1, 7, 64])
@pytest.mark.parametrize("value,ascending", [("v", False), ("v", True), ("n", False), ("d", True), ("k", True)])
def test_rank(table, value, ascending, ranges):
    order = F.col(value).asc() if ascending else F.col(value).desc()
    same(
        rg.with_rank(table, value, "r", ascending, ranges=ranges),
        table.withColumn("r", F.rank().over(Window.orderBy(order)).cast("bigint")),
    )


def test_rank_within_groups(table):
    want = F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc())).cast("bigint")
    same(rg.with_rank(table, "v", "r", within=["g"], ranges=9), table.withColumn("r", want))


@pytest.mark.parametrize("key,ascending", [("k", True), ("x", True), ("x", False)])
def test_running_sums(table, key, ascending):
    order = F.col(key).asc() if ascending else F.col(key).desc()
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    want = table.withColumn("s", F.sum("v").over(upto)).withColumn("t", F.sum("n").over(upto))
    same(rg.with_running_sums(table, [(key, ascending)], {"s": "v", "t": "n"}, ranges=11).withColumn("s", F.col("s").cast("decimal(38,4)")), want)


def test_percent_rank_and_total(table):
    want = table.withColumn("p", F.percent_rank().over(Window.orderBy(F.col("v").asc())))
    same(rg.with_percent_rank(table, "v", "p"), want)
    total = sum(r["v"] for r in table.collect() if r["v"] is not None)
    assert {r["t"] for r in rg.with_total(table, "v", "t").collect()} == {total}


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    small = spark.createDataFrame(rows(n), SCHEMA)
    assert rg.with_rank(small, "v", "r").count() == n
    assert [r["p"] for r in rg.with_percent_rank(small, "v", "p").collect()] == [0.0] * n
    assert rg.with_running_sums(small, [("k", True)], {"s": "v"}).count() == n


def test_digits_follow_the_order(spark):
    texts = ["", "a", "ab", "ab\x00", "abc", "abcdef", "abcdefg", "abcdeg", "b", "é", "\U0001f600", None]
    df = spark.createDataFrame([(t,) for t in texts], "k string")
    one, two, *_ = rg.digits("k", df.schema["k"].dataType)
    got = df.select("k", F.expr(one).alias("a"), F.expr(two).alias("b")).collect()
    assert [r["k"] for r in sorted(got, key=lambda r: (r["a"], r["b"]))] == sorted(texts, key=lambda t: (t is not None, (t or "").encode()))
    with pytest.raises(TypeError):
        rg.digits("k", df.schema["k"].dataType, ascending=False)


def single_partition_inputs(df):
    """The plan's exchanges into one task that no aggregate or limited set of ranges feeds."""
    found = []

    def visit(node):
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange" and "SinglePartition" in node.toString().split("\n")[0]:
            found.append(kids[0].nodeName() + " " + kids[0].toString().split("\n")[0])
        for k in kids:
            visit(k)

    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        visit(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return found


def test_no_rows_into_one_task(table):
    for df in (
        rg.with_rank(table, "v", "r"),
        rg.with_running_sums(table, [("k", True)], {"s": "v"}),
        rg.with_percent_rank(table, "v", "p"),
        rg.with_total(table, "v", "t"),
    ):
        for fed_by in single_partition_inputs(df):
            # partial one-row aggregates, or the one row per range
            assert "Aggregate" in fed_by and ("keys=[]" in fed_by or "_range" in fed_by), fed_by


# ---- the analyses over groups of any number
@pytest.fixture(scope="module")
def lines(spark, sf_dir, scratch_dir):
    from salescope.sources.star import order_lines

    path = f"{scratch_dir}/range-lines"
    order_lines(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def half_up(x, k):
    return None if x is None else int(abs(x) * 10**k + 0.5) / 10**k * (1 if x >= 0 else -1)


def test_category_mix_by_product(lines):
    from salescope.operators.profile import category_mix

    got = category_mix(lines, by="Product_ID", k=7)
    assert all("keys=[]" in x for x in single_partition_inputs(got) if "TakeOrdered" not in x)
    total = lines.count()
    want = sorted(((-r["count"], r["Product_ID"]) for r in lines.groupBy("Product_ID").count().collect()))[:7]
    assert [(-r["order_lines"], r["Product_ID"]) for r in got.collect()] == want
    assert [r["pct_of_lines"] for r in got.collect()] == [half_up(-100.0 * n / total, 1) for n, _ in want]


def test_leaderboard_by_product(lines):
    from salescope.operators.trends import revenue_leaderboard

    by = ["Region", "Product_ID"]
    got = revenue_leaderboard(lines, by=by)
    for fed_by in single_partition_inputs(got):
        assert "Aggregate" in fed_by and ("keys=[]" in fed_by or "_range" in fed_by), fed_by
    groups = lines.groupBy(*by).agg(F.round(F.sum("Sales"), 2).alias("v"))
    want = groups.select(
        *by,
        F.rank().over(Window.partitionBy("Region").orderBy(F.col("v").desc())).cast("bigint").alias("revenue_rank_in_region"),
        F.rank().over(Window.orderBy(F.col("v").desc())).cast("bigint").alias("global_revenue_rank"),
    )
    same(got.select(*want.columns), want)


@pytest.mark.parametrize("by", ["Order_Date", "Customer_ID"])
def test_running_total_by_any_column(lines, by):
    from salescope.operators.trends import running_total

    got = running_total(lines, by=by)
    for fed_by in single_partition_inputs(got):
        assert "Aggregate" in fed_by and ("keys=[]" in fed_by or "_range" in fed_by), fed_by
    upto = Window.orderBy(F.col(by).asc()).rowsBetween(Window.unboundedPreceding, 0)
    groups = lines.groupBy(by).agg(F.sum("Sales").alias("s"), F.sum("Profit").alias("p"), F.countDistinct("Order_ID").alias("orders"))
    want = groups.select(
        by,
        F.round(F.sum("s").over(upto), 2).cast("double").alias("cumulative_revenue"),
        F.round(F.sum("p").over(upto), 2).cast("double").alias("cumulative_profit"),
        "orders",
    )
    same(got.select(*want.columns), want)
    assert got.collect()[-1]["cumulative_pct_of_total"] == 100.0


def test_cohort_value_by_day_and_segment(lines):
    from salescope.operators.cohorts import cohort_value

    got = cohort_value(lines, period="day", by=["Segment"])
    for fed_by in single_partition_inputs(got):
        assert "Aggregate" in fed_by and ("keys=[]" in fed_by or "_range" in fed_by), fed_by
    rows = got.collect()
    assert sum(r["cohort_size"] for r in rows) == lines.select("Customer_ID").distinct().count()
    spends = sorted(r["avg_lifetime_spend"] for r in rows)
    for r in rows:
        below = sum(s < r["avg_lifetime_spend"] for s in spends)
        assert abs(r["spend_percentile"] - 100.0 * below / (len(rows) - 1)) <= 0.11
    assert cohort_value(lines, period="month").columns[0] == "cohort_month"
    assert [tuple(r) for r in cohort_value(lines, period="year").collect()] == [tuple(r) for r in cohort_value(lines).collect()]
