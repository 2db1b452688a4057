"""salescope: retail order-line analytics as Spark DataFrame operators.

Every analysis is a function ``lines: DataFrame -> DataFrame`` over the flat
order-line schema in :mod:`salescope.schema`. Thresholds are keyword
arguments. Nothing is collected to the driver except bounded metadata
(a one-row count, a sample of at most a few thousand sort keys).
"""

from salescope.schema import ORDER_LINE_SCHEMA

__all__ = ["ORDER_LINE_SCHEMA"]
