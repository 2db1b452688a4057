"""Helpers shared by the operators: scratch tables, components, grouping.

Scratch tables go to the folder the session names in ``spark.checkpoint.dir``
(shared by driver and executors). Only where it is unset, as in tests, a
temporary folder is made and named there. Tables are Parquet, so a lost
executor costs a re-read; :func:`release_scratch` removes them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.plans.session import checkpoint_dir

#: The characters that separate words in the contracts: space and U+0009-U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"

_SCRATCH: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    if not folder:
        folder = tempfile.mkdtemp(prefix="salescope-llm-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a scratch table and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_tables(spark: SparkSession) -> list[str]:
    """Paths of this application's scratch tables, in the order in which they were made."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def release_scratch(spark: SparkSession, tables: list[str] | None = None) -> int:
    """Remove this application's scratch tables, or those of ``tables`` only; returns
    how many there were.

    Call it when no DataFrame that an operator returned from them is read any more.
    """
    held = _SCRATCH.get(spark.sparkContext.applicationId, [])
    paths = [p for p in held if tables is None or p in set(tables)]
    for path in paths:
        remove(spark, path)
        held.remove(path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def row_struct(df: DataFrame):
    """All columns of a row as one struct with the fields c0, c1, ..."""
    return F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))


def word_count(text):
    """Number of maximal runs of non-blank characters; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(
        F.size(F.split(trimmed, BLANK_CLASS + "+"))
    ).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id with an edge to another; root is the smallest id
    reachable. Roots themselves have no row.

    Alternating large-star and small-star steps (Kiveris et al. 2014) on
    (hi, lo) pairs. Each step is two aggregations and two joins; the minimum is
    taken with map-side aggregation and the joins have one row per key on one
    side, so AQE can split a hot centre. Each round is written as a table; the
    rounds, about the logarithm of the longest path, end when it repeats.
    """
    u, v = F.col("u"), F.col("v")
    cur = write_table(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        state = cur.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == before or state["n"] == 0:
            return cur.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        before = state
        both = cur.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(
            cur.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        )
        least = both.groupBy("a").agg(F.min("b").alias("nb")).select("a", F.least("a", "nb").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small, "hi").select("hi", "lo", "m")
        cur = write_table(
            joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionAll(joined.select("hi", F.col("m").alias("lo")))
            .distinct(),
            "stars",
        )


def by_key(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of consecutive rows with equal keys, across batches. The input
    is sorted by the keys; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            if held and rows[start] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = rows[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield held_key, pa.Table.from_batches(held)
