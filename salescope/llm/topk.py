"""Exact top-k search (operator 9) by multi-resolution segment statistics.

A vector cut into segments has a mean and a deviation in each. By the
inequality of Cauchy and Schwarz, sum(l * (mq * mx + sq * sx)) over segments of
length l bounds an inner product from above, and with it a distance from below. More and
shorter segments bound more closely. Rows are dropped from coarse to fine; the
inner products of the survivors are computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

K = 10
EVERY = 100
SCALE = 1024
#: Segments of the levels, coarse to fine.
LEVELS = (1, 4, 16)
#: Queries and rows of a block.
QUERY_BLOCK, ROW_BLOCK = 2048, 4096


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ints, floor(scale * x) of each component; rows whose id or vector
    is null, or that hold a null or non-finite component, are left out. Components
    beyond 64 bits stop there. Rows that repeat a vec_id stay."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
        .where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", finite))
        .select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("ints"))
    )


def segment_features(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(sqrt(l) * mean, sqrt(l) * deviation) of each segment of each row."""
    parts = np.array_split(np.arange(x.shape[1]), segments)
    means = np.stack([np.sqrt(len(p)) * x[:, p].mean(axis=1) for p in parts], axis=1)
    spreads = np.stack([np.sqrt(len(p)) * x[:, p].std(axis=1) for p in parts], axis=1)
    return means, spreads


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits they stop there."""
    top = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).max(initial=0))
    if top * max(1, rows.shape[1]) < 2**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    exact = [sum(a * b for a, b in zip(r, query.tolist(), strict=True)) for r in rows.tolist()]
    return np.array([max(-(2**63), min(2**63 - 1, v)) for v in exact], dtype=np.int64)


def block_top(
    query_numbers: np.ndarray, queries: np.ndarray, floors: list[int | None], numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(number of the query's row, vec_id, score) of the k best rows of a block for each
    query; of all rows that may tie with the k-th, the smaller ids. Rows that score
    less than a query's floor may be left out."""
    order = np.argsort(ids, kind="stable")
    numbers, ids, rows = numbers[order], ids[order], rows[order]
    dim = rows.shape[1]
    levels = [s for s in LEVELS if s <= dim]
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    bounds = []
    for s in levels:
        (qm, qs), (xm, xs) = segment_features(q, s), segment_features(x, s)
        bounds.append((np.concatenate([qm, qs], axis=1), np.concatenate([xm, xs], axis=1)))
    slack = 1.0 + 1e-9 * dim * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    out = []
    for at, query in enumerate(query_numbers.tolist()):
        left = np.flatnonzero(numbers != query)
        floor = floors[at]
        if levels and floor is None and len(left) > k:
            a, b = bounds[-1]
            guess = b[left] @ a[at]
            first = left[np.argpartition(-guess, k - 1)[:k]]
            floor = int(_products(rows[first], queries[at]).min())
        if levels and floor is not None:
            for a, b in bounds:
                left = left[b[left] @ a[at] + slack >= floor]
        scores = _products(rows[left], queries[at])
        best = np.lexsort((ids[left], -scores.astype(object) if len(scores) and scores.min() == -(2**63) else -scores))[:k]
        out += [(query, int(ids[left[i]]), int(scores[i])) for i in best]
    return out


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id is divisible by
    ``every``, the ``k`` other rows with the highest inner products, ties to the
    smaller vec_id; all, if there are fewer. Rows are told apart by number, not by
    vec_id: of rows that repeat one each is a query of its own, and a candidate of the
    others. Rows of other lengths than the query's are no candidates; see
    :func:`integer_vectors` for the rest.

    The stated queries meet all rows in blocks: each task has one block of
    queries and one of rows, so its memory is bounded at any size. The queries meet the
    first block, rows of random numbers, before the others, which then leave out what
    scores less than the k-th best there.
    """
    numbered = integer_vectors(vectors).withColumn("number", F.monotonically_increasing_id())
    rows = write_table(numbered, "ints").withColumn("dim", F.size("ints"))
    queries = rows.where(F.col("vec_id") % every == 0)
    n_rows = max(1, -(-rows.count() // row_block))
    n_queries = max(1, -(-queries.count() // query_block))
    block = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    all_of = lambda low, n: F.explode(F.sequence(F.lit(low), F.lit(n - 1)))
    asked = queries.withColumn("qb", block(n_queries))
    there = rows.withColumn("rb", block(n_rows)).withColumn("qb", all_of(0, n_queries))

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and there.num_rows:
            found = block_top(
                asked.column("number").to_numpy(), _matrix(asked.column("ints")), asked.column("floor").to_pylist(),
                there.column("number").to_numpy(), there.column("vec_id").to_numpy(), _matrix(there.column("ints")), k,
            )
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "vec_id", "score"])

    def met(asked: DataFrame, there: DataFrame) -> DataFrame:
        keys = ["dim", "qb", "rb"]
        return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(search, "query long, vec_id long, score long")

    none = F.lit(None).cast("long")
    first = write_table(met(asked.withColumn("rb", F.lit(0)).withColumn("floor", none), there.where("rb = 0")), "first")
    floors = first.groupBy(F.col("query").alias("number")).agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    found = first
    if n_rows > 1:
        limited = asked.join(floors.where(F.col("n") == k).drop("n"), "number", "left").withColumn("rb", all_of(1, n_rows))
        found = first.unionAll(met(limited.toDF(*limited.columns), there.where("rb > 0")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    names = queries.select(F.col("number").alias("query"), F.col("vec_id").alias("query_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .join(names, "query")
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
