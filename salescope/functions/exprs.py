"""Column expressions shared by the analyses.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen. Rounding, ratios and averages are written so that Spark and the
DuckDB oracle perform the same IEEE operations in the same order:

* money sums stay DECIMAL (exact) and are rounded as DECIMAL, then cast;
* ratios are ``100.0 * double(num) / nullif(double(den), 0)``;
* averages are ``double(sum(x)) / count(x)``;
* doubles are rounded half away from zero with ``floor(|x|*10^k + 0.5)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: str | Column) -> Column:
    return col(c).cast("double")


def nonzero(c: str | Column) -> Column:
    """``nullif(double(c), 0)``: a zero denominator gives NULL, not an error."""
    d = as_double(c)
    return F.when(d != 0, d)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    return as_double(num) / nonzero(den)


def pct(num: str | Column, den: str | Column) -> Column:
    """``100.0 * num / den`` in doubles, NULL when den is 0 or NULL."""
    return F.lit(100.0) * as_double(num) / nonzero(den)


def round_half_up(x: str | Column, k: int) -> Column:
    """Round a double half away from zero to ``k`` decimals.

    Written out so that the oracle SQL can repeat it operation for
    operation; never produces a negative zero.
    """
    x = as_double(x)
    s = 10**k
    neg = F.lit(0.0) - F.floor(F.lit(0.5) - x * s).cast("double")
    pos = F.floor(x * s + F.lit(0.5)).cast("double")
    return F.when(x < 0, neg).otherwise(pos) / F.lit(float(s))


def money(x: str | Column, k: int = 2) -> Column:
    """Round a DECIMAL amount exactly, then expose it as DOUBLE."""
    return F.round(col(x), k).cast("double")


def margin_pct(profit: str | Column, sales: str | Column, k: int = 2) -> Column:
    return round_half_up(pct(profit, sales), k)


def mean(x: str | Column) -> Column:
    """AVG as ``double(sum) / count`` (aggregate context)."""
    return safe_ratio(F.sum(col(x)), F.count(col(x)))


def count_rows() -> Column:
    return F.count(F.lit(1))


def count_if(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END): NULL over no rows, like SQL."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def year_text(d: str | Column) -> Column:
    return F.date_format(col(d), "yyyy")


def month_text(d: str | Column) -> Column:
    return F.date_format(col(d), "MM")


def year_month_text(d: str | Column) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def day_diff(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from ``earlier`` to ``later`` as BIGINT."""
    return F.datediff(col(later), col(earlier)).cast("bigint")


def ship_days() -> Column:
    return day_diff("Ship_Date", "Order_Date")
