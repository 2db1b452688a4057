"""The flat order-line store: Parquet partitioned by ``order_year`` (IO-11).

The store is read with the columns it was written with, so filters on typed
columns reach the scan as Parquet pushed filters and a filter on
``order_year`` prunes whole directories. Its refresh (IO-8) writes a new version
and switches to it at once (:mod:`salescope.sources.versions`).

Two layouts:

* by year: rows of a year in files of about the advisory size, the default;
* clustered: by year and, within it, bucketed and sorted by ``Order_ID``. Steps by
  order (A20 to A22, and the distinct orders of most analyses) then read each order
  in one task and move no lines.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.schema import ORDER_LINE_SCHEMA, SHIPPING_COST
from salescope.sources.csv_ingest import with_order_year, write_order_lines
from salescope.sources.star import order_lines
from salescope.sources.versions import KEEP, current_version, refresh

STORE_TYPES = {f.name: f.dataType for f in [*ORDER_LINE_SCHEMA.fields, SHIPPING_COST]} | {"order_year": T.IntegerType()}


#: Column that the clustered layout buckets and sorts by.
CLUSTER_KEY = "Order_ID"
_CLUSTERED = re.compile(r"\.by_order_(\d+)$")


def refresh_order_store(spark: SparkSession, lines: DataFrame, path: str, keep: int = KEEP) -> DataFrame:
    """IO-8: full refresh by a staged write and one switch; returns the new store.

    ``lines`` may be read from the store itself. Readers that planned on the version
    before finish on it; older ones than the ``keep`` newest are removed.
    """
    refresh(spark, path, lambda folder: write_order_lines(lines, folder), keep=keep)
    return read_order_store(spark, path)


def refresh_clustered_store(
    spark: SparkSession, lines: DataFrame, path: str, buckets: int, keep: int = KEEP
) -> DataFrame:
    """IO-8 in the clustered layout, with ``buckets`` files a year (about the bytes of a
    year by 256 MB); returns the new store.

    One shuffle brings the lines of an order into one task, which sorts them with
    spilling. A bucket is read by one task, so choose the layout by year where one
    order (or a NULL one) may hold a large share of all lines.
    """
    if buckets < 1:
        raise ValueError("a clustered store has at least one bucket")

    def write(folder: str) -> None:
        table = f"salescope_write_{uuid.uuid4().hex}"
        (
            with_order_year(lines)
            .repartition(buckets, CLUSTER_KEY)
            .write.partitionBy("order_year")
            .bucketBy(buckets, CLUSTER_KEY)
            .sortBy(CLUSTER_KEY)
            .option("path", folder)
            .format("parquet")
            .saveAsTable(table)
        )
        spark.sql(f"DROP TABLE {table}")  # an external table: the files stay

    refresh(spark, path, write, tag=f"by_order_{buckets}", keep=keep)
    return read_order_store(spark, path)


#: Catalog entries that this application made over clustered versions.
_TABLES: dict[str, set[str]] = {}


def _table_of(folder: str) -> str:
    return "salescope_store_" + hashlib.sha256(folder.encode()).hexdigest()[:24]


def _read_clustered(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """The files with their buckets. Only a catalog entry can name buckets, so one is
    made over the folder, which never changes; :func:`release_store_tables` drops it."""
    table = _table_of(folder)
    columns = ", ".join(
        f"`{f.name}` {STORE_TYPES['order_year'].simpleString() if f.name == 'order_year' else f.dataType.simpleString()}"
        for f in spark.read.parquet(folder).schema.fields
    )
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    if not spark.catalog.tableExists(table):
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (order_year) "
            f"CLUSTERED BY ({CLUSTER_KEY}) SORTED BY ({CLUSTER_KEY}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {table}")
        _TABLES.setdefault(spark.sparkContext.applicationId, set()).add(table)
    return spark.table(table)


def release_store_tables(spark: SparkSession) -> int:
    """Drop the catalog entries over clustered versions (the files stay); returns how
    many there were. Call it when no frame of a clustered store is read any more."""
    held = _TABLES.pop(spark.sparkContext.applicationId, set())
    for table in held:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return len(held)


def read_order_store(spark: SparkSession, path: str, keep_year: bool = False) -> DataFrame:
    """Every stored column of the current version (or of a plain table), pass-through
    ones included; known ones are cast where they were stored with another type."""
    folder = current_version(spark, path) or path
    clustered = _CLUSTERED.search(folder)
    df = _read_clustered(spark, folder, int(clustered[1])) if clustered else spark.read.parquet(folder)
    casts = {
        f.name: F.col(f.name).cast(STORE_TYPES[f.name])
        for f in df.schema.fields
        if f.dataType != STORE_TYPES.get(f.name, f.dataType)
    }
    df = df.withColumns(casts) if casts else df
    return df if keep_year else df.drop("order_year")


def build_store_from_star(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Write the star-derived flat lines once as the store and read it back."""
    return refresh_order_store(spark, order_lines(spark, sf_dir), path)
