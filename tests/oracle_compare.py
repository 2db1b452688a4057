"""Spark-vs-DuckDB comparison: row count, column names and types, and the
order-insensitive multiset of exact values (columns sorted by name)."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

SPARK_TO_CANON = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return float(v)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark_df, con, sql: str) -> list[str]:
    """Return a list of differences (empty when the results match)."""
    problems: list[str] = []
    s_cols = spark_df.columns
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if sorted(s_cols) != sorted(d_cols):
        return [f"columns differ: spark={s_cols} duck={d_cols}"]
    for c in s_cols:
        st = SPARK_TO_CANON.get(s_types[c], s_types[c])
        if st != d_types[c]:
            problems.append(f"type of {c}: spark={s_types[c]} duck={d_types[c]}")
    names = sorted(s_cols)
    s_idx = [s_cols.index(c) for c in names]
    d_idx = [d_cols.index(c) for c in names]
    s_rows = sorted((tuple(_canon(r[i]) for i in s_idx) for r in spark_df.collect()), key=_key)
    d_rows = sorted((tuple(_canon(r[i]) for i in d_idx) for r in rel.fetchall()), key=_key)
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark={len(s_rows)} duck={len(d_rows)}")
        return problems
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ; first: spark={bad[0][0]} duck={bad[0][1]} cols={names}")
    return problems
