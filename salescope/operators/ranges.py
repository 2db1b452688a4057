"""Running sums, ranks and totals over relations of any number of groups.

``F.sum(...).over(Window.orderBy(...))`` and ``F.rank().over(Window.orderBy(...))`` move
every row to one task. Here the rows are dealt over ranges of the ordering key, whose
limits come from a quantile sketch; a range knows the sums of the ranges before it (one
row per range), and only the rest is a window, over one range at a time. Ranks are
running counts over the distinct values, so a value that a third of all rows share
is one row. Everything is planned lazily; the input is read several times and should be a
written table (:func:`salescope.plans.session.materialize`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that rows are dealt over, and the sketch's size (rank error about 0.4 %).
RANGES, SKETCH_K = 64, 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Bytes of a string in a digit, and digits of a string.
STRING_BYTES, STRING_DIGITS = 6, 8


def digits(expr: str, dtype: T.DataType, ascending: bool = True) -> list[str]:
    """SQL of BIGINTs that follow the order of ``expr``: each never falls where the
    values before it are equal and ``expr`` rises. Ascending has NULLs first, descending
    last. Different values may share all digits (long strings, very large numbers)."""
    if isinstance(dtype, T.StringType):
        if not ascending:
            raise TypeError("descending keys must be numbers, dates or booleans")
        raw = f"CAST({expr} AS BINARY)"
        out = []
        for k in range(STRING_DIGITS):
            part = f"rpad(hex(substring({raw}, {k * STRING_BYTES + 1}, {STRING_BYTES})), {2 * STRING_BYTES}, '0')"
            here = f"greatest(0, least({STRING_BYTES}, octet_length({expr}) - {k * STRING_BYTES}))"
            out.append(f"coalesce(CAST(conv({part}, 16, 10) AS BIGINT) * 8 + {here}, {_literal(LEAST)})")
        return out
    if isinstance(dtype, T.DecimalType):
        top = 9 * 10**18 // 10**dtype.scale
        one = f"least(greatest({expr}, CAST(-{top} AS DECIMAL(38, 0))), CAST({top} AS DECIMAL(38, 0)))"
        number = f"CAST(CAST({one} AS DECIMAL(38, {dtype.scale})) * CAST(1{'0' * dtype.scale} AS DECIMAL({dtype.scale + 1}, 0)) AS BIGINT)"
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        number = f"CAST(greatest(least(CAST({expr} AS DOUBLE) * 1e6D, 9e18D), -9e18D) AS BIGINT)"
    elif isinstance(dtype, T.DateType):
        number = f"CAST(unix_date({expr}) AS BIGINT)"
    elif isinstance(dtype, T.TimestampType):
        number = f"unix_micros({expr})"
    elif isinstance(dtype, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        number = f"greatest(CAST({expr} AS BIGINT), {_literal(-MOST)})"
    else:
        raise TypeError(f"no ordered digits for {dtype.simpleString()}")
    return [f"coalesce({number}, {_literal(LEAST)})"] if ascending else [f"coalesce(-({number}), {_literal(MOST)})"]


def _literal(n: int) -> str:
    return "(-9223372036854775807L - 1L)" if n == LEAST else f"{n}L"


def _in_ranges(table: DataFrame, digit: str, ranges: int) -> DataFrame:
    """``table`` with ``_range``, 0 to ``ranges`` - 1, by the quantiles of ``digit``."""
    at = ", ".join(f"{k / ranges!r}D" for k in range(1, ranges))
    limits = table.agg(F.expr(f"kll_sketch_agg_bigint({digit}, {SKETCH_K})").alias("_sketch")).select(
        F.expr(
            f"CASE WHEN kll_sketch_get_n_bigint(_sketch) > 0 THEN kll_sketch_get_quantile_bigint(_sketch, array({at})) END"
        ).alias("_limits")
    )
    reached = " + ".join(f"CAST(_limits[{k}] < _digit AS INT)" for k in range(ranges - 1)) or "0"
    return (
        table.withColumn("_digit", F.expr(digit))
        .crossJoin(F.broadcast(limits))  # one row
        .withColumn("_range", F.coalesce(F.expr(reached), F.lit(0)))
        .drop("_digit", "_limits")
    )


def with_running_sums(
    table: DataFrame,
    order: Sequence[tuple[str, bool]],
    sums: dict[str, str],
    within: Sequence[str] = (),
    inclusive: bool = True,
    ranges: int = RANGES,
) -> DataFrame:
    """Add ``{new: column}`` running sums in the order of ``order`` ((column, ascending),
    ...), per ``within``; not ``inclusive``: of the rows before. Rows should be distinct
    in ``order`` and ``within``; NULLs come first ascending, last descending. Sums of no
    rows are NULL, or 0 when not inclusive."""
    within = list(within)
    key, ascending = order[0]
    placed = _in_ranges(table, digits(f"`{key}`", table.schema[key].dataType, ascending)[0], ranges)
    totals = placed.groupBy(*within, "_range").agg(*[F.sum(c).alias(f"_own_{new}") for new, c in sums.items()])
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *[F.col(c).alias(f"_at_{c}") for c in within],
        F.col("_range").alias("_at_range"),
        *[F.sum(f"_own_{new}").over(earlier).alias(f"_before_{new}") for new in sums],
    )
    same = F.col("_range") == F.col("_at_range")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    # without within, one row per range; else as many as groups, which Spark measures
    joined = placed.join(before if within else F.broadcast(before), same)
    rows = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    upto = Window.partitionBy(*within, "_range").orderBy(*rows).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = joined
    for new, c in sums.items():
        own, earlier_sum = F.sum(c).over(upto), F.col(f"_before_{new}")
        both = F.when(own.isNull(), earlier_sum).when(earlier_sum.isNull(), own).otherwise(own + earlier_sum)
        out = out.withColumn(new, both if inclusive else F.coalesce(both, F.lit(0)))
    return out.drop("_range", "_at_range", *[f"_at_{c}" for c in within], *[f"_before_{new}" for new in sums])


def with_rank(
    table: DataFrame, value: str, out: str, ascending: bool = False, within: Sequence[str] = (), ranges: int = RANGES
) -> DataFrame:
    """Add ``out``, RANK() over ``value`` per ``within``: one more than the rows before
    the value. NULLs come first ascending, last descending."""
    within = list(within)
    values = table.groupBy(*within, value).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = with_running_sums(values, [(value, ascending)], {"_ahead": "_rows"}, within, False, ranges)
    ahead = ahead.select(*[F.col(c).alias(f"_of_{c}") for c in [*within, value]], "_ahead")
    same = F.lit(True)
    for c in [*within, value]:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return (
        table.join(ahead, same)
        .withColumn(out, (F.col("_ahead") + 1).cast("bigint"))
        .drop("_ahead", *[f"_of_{c}" for c in [*within, value]])
    )


def with_total(table: DataFrame, col: str | Column, out: str) -> DataFrame:
    """Add the sum of ``col`` over all rows, from a one-row aggregate."""
    return table.crossJoin(F.broadcast(table.agg(F.sum(col).alias(out))))


def with_percent_rank(table: DataFrame, value: str, out: str, ascending: bool = True, ranges: int = RANGES) -> DataFrame:
    """Add ``out``, PERCENT_RANK() over ``value``: (rank - 1) / (rows - 1), 0 for one row."""
    ranked = with_rank(table, value, "_place", ascending, ranges=ranges)
    rows = table.agg(F.count(F.lit(1)).alias("_of_all"))
    others = (F.col("_of_all") - 1).cast("double")
    share = F.when(others > 0, (F.col("_place") - 1).cast("double") / others).otherwise(F.lit(0.0))
    return ranked.crossJoin(F.broadcast(rows)).withColumn(out, share).drop("_place", "_of_all")
