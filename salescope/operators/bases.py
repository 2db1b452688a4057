"""Bases that several analyses share (H8), written once for a batch of them.

Six analyses start from the sums of each month, five from the sums of each customer.
Run one by one, each reads all lines. Within :func:`shared_bases` the first that
needs a base writes it to the session's checkpoint folder, the others read it there,
and at the end it is removed. The lines are read once for each base, and once for
each analysis without one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame

from salescope.operators import cohorts, customers, exports, profitability, trends
from salescope.operators.common import month_sums
from salescope.plans.session import materialize, materialized_scope

BY_MONTH = frozenset(
    {
        profitability.monthly_trend,
        trends.mom_growth,
        trends.rolling_average,
        trends.running_total,
        cohorts.same_month_yoy,
        exports.export_monthly_mom_growth,
    }
)
BY_CUSTOMER = frozenset(
    {
        customers.customer_value_overview,
        customers.rfm_scores,
        customers.rfm_segment_summary,
        customers.revenue_concentration,
        exports.export_rfm_segment_summary,
    }
)


class Bases:
    """The bases of ``lines``, each written when it is first asked for."""

    def __init__(self, lines: DataFrame):
        self.lines = lines
        self._months: DataFrame | None = None
        self._customers: DataFrame | None = None

    def months(self) -> DataFrame:
        if self._months is None:
            self._months = materialize(month_sums(self.lines))
        return self._months

    def customers(self) -> DataFrame:
        if self._customers is None:
            self._customers = materialize(customers.customer_sums(self.lines))
        return self._customers

    def run(self, analysis: Callable[..., DataFrame], **kw) -> DataFrame:
        """``analysis`` of the lines, from a shared base where it has one. A running
        total by another column than the month reads the lines."""
        if analysis in BY_MONTH and kw.get("by") is None:
            return analysis(self.lines, base=self.months(), **kw)
        if analysis in BY_CUSTOMER:
            return analysis(self.lines, base=self.customers(), **kw)
        return analysis(self.lines, **kw)


@contextmanager
def shared_bases(lines: DataFrame) -> Iterator[Bases]:
    """Bases for the analyses inside; what they write is removed at the end, so write
    or collect the results inside."""
    with materialized_scope(lines.sparkSession):
        yield Bases(lines)


def write_reports(
    lines: DataFrame, out_dir: str, analyses: dict[str, Callable[..., DataFrame]], names: Sequence[str] | None = None
) -> DataFrame:
    """Run ``analyses`` (or ``names`` of them) on shared bases and write each result as
    Parquet under ``out_dir``; returns a manifest (name, rows, path). Row counts are
    read back from what was written."""
    unknown = sorted(set(names or ()) - set(analyses))
    if unknown:
        raise ValueError(f"unknown analyses {unknown}")
    spark = lines.sparkSession
    manifest = []
    with shared_bases(lines) as bases:
        for name, analysis in analyses.items():
            if names is not None and name not in names:
                continue
            path = f"{out_dir.rstrip('/')}/{name}"
            result = bases.run(analysis)
            result.write.mode("overwrite").parquet(path)
            manifest.append((name, spark.read.schema(result.schema).parquet(path).count(), path))
    return spark.createDataFrame(manifest, "name string, rows bigint, path string")
