"""Session construction for tests and the benchmark, and lineage cutting.

The library never invents a checkpoint folder on a cluster: it reads
``spark.checkpoint.dir`` from the session. Only callers that own the session
(tests, ``bench.py``) pass a fallback folder, used when the setting is unset.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "salescope",
    checkpoint_dir: str | None = None,
    driver_memory: str = "8g",
    extra_conf: dict | None = None,
) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
    )
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext, the server owns the setting
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    return None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None) -> str | None:
    """Use the session's checkpoint folder; set ``fallback`` only if none is set."""
    current = checkpoint_dir(spark)
    if current is None and fallback:
        spark.sparkContext.setCheckpointDir(fallback)
        current = spark.sparkContext.getCheckpointDir()
    return current


#: What materialize wrote or persisted, by application.
_MATERIALIZED: dict[str, list[str | DataFrame]] = {}
#: What materialize made inside the innermost scope of this thread.
_SCOPE: ContextVar[list[str | DataFrame] | None] = ContextVar("salescope_scope", default=None)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_materialized(spark: SparkSession) -> int:
    """Remove what :func:`materialize` made in this application; returns how much
    there was. Call it when no result of an analysis is read any more."""
    held = _MATERIALIZED.pop(spark.sparkContext.applicationId, [])
    _free(spark, held)
    return len(held)


def _free(spark: SparkSession, items: list[str | DataFrame]) -> None:
    for item in items:
        if isinstance(item, str):
            remove_path(spark, item)
        else:
            item.unpersist()


@contextmanager
def materialized_scope(spark: SparkSession) -> Iterator[None]:
    """What :func:`materialize` makes inside is freed at the end, also after an error;
    what was made before, or by other threads, stays. Results must be written inside."""
    made: list[str | DataFrame] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        held = _MATERIALIZED.get(spark.sparkContext.applicationId, [])
        held[:] = [x for x in held if not any(x is y for y in made)]
        _free(spark, made)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage; :func:`release_materialized` frees it.

    With a checkpoint folder (shared storage on a cluster) the result is
    written there as a Parquet table and read back: a lost executor costs a
    re-read, not a recompute of the upstream plan, and later passes read
    only the columns they need (a row count comes from file metadata).
    Without a folder, fall back to a disk-backed persist, which Spark
    recomputes from lineage if blocks are lost.
    """
    folder = checkpoint_dir(df.sparkSession)
    held = [_MATERIALIZED.setdefault(df.sparkSession.sparkContext.applicationId, [])]
    if (scope := _SCOPE.get()) is not None:
        held.append(scope)
    if folder:
        path = f"{folder.rstrip('/')}/salescope-{uuid.uuid4().hex}"
        for names in held:
            names.append(path)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    for names in held:
        names.append(kept)
    return df
