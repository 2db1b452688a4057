"""Embedding near-dedup (operator 7) on a robust-pruned flat graph.

Vectors go to their nearest clusters, several each, so that shards overlap. In
each shard a flat graph is built: near neighbours and some far nodes, pruned so
that no kept neighbour is much nearer to another. The adjacency lists of a
vector's shards are united. A greedy search from the shard's medoids finds
the neighbourhood of each vector and then widens to all nodes in range. Pairs
in range are verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, connected_components, write_table

THRESHOLD = 0.98
#: The search widens from nodes this similar.
EXPAND = 0.95
#: Centroids are fitted on at most so many vectors, in the order of a hash.
SAMPLE = 131_072
#: One cluster for so many vectors, up to MAX_CLUSTERS, which are sent to all tasks.
CLUSTER_ROWS, MAX_CLUSTERS = 512, 16_384
#: Clusters of each vector.
OVERLAP = 3
#: Nodes of a shard; larger clusters are split and searched part by part.
SHARD_NODES = 1024
#: Neighbours of a node, pool they are chosen from, pruning factor, beam.
DEGREE, POOL, FAR, ALPHA, BEAM = 24, 48, 16, 1.2, 32


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from rows at even distances."""
    centers = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ centers.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        norms = np.sqrt((sums * sums).sum(axis=1))
        full = norms > 0
        centers[full] = sums[full] / norms[full, None]
    return centers


def robust_prune(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adjacency of a flat graph over unit vectors, both directions."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    pool = min(POOL, n - 1)
    near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
    far = np.random.default_rng(seed).integers(0, n, (n, min(FAR, n - 1)))
    pool_ids = np.concatenate([near, far], axis=1)
    own = sims[np.arange(n)[:, None], pool_ids]
    order = np.argsort(-own, axis=1, kind="stable")
    pool_ids = np.take_along_axis(pool_ids, order, axis=1)
    distance = np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(-1.0, np.take_along_axis(own, order, axis=1))))
    np.fill_diagonal(sims, 1.0)
    alive = pool_ids != np.arange(n)[:, None]
    edges = np.zeros((n, n), dtype=bool)
    at = np.arange(n)
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        has = alive[at, first]
        if not has.any():
            break
        chosen = pool_ids[at, first]
        edges[at[has], chosen[has]] = True
        between = np.sqrt(np.maximum(0.0, 2 - 2 * sims[chosen[:, None], pool_ids]))
        alive &= ~(has[:, None] & (ALPHA * between <= distance))
        alive[at, first] = False
        alive &= pool_ids != chosen[:, None]
    edges |= edges.T
    return [np.flatnonzero(r) for r in edges]


def medoids(x: np.ndarray, count: int = 8) -> np.ndarray:
    """The node nearest to the mean, and further ones far from those chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    closest = x @ x[chosen[0]]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, x @ x[chosen[-1]])
    return np.unique(chosen)


def range_search(queries: np.ndarray, x: np.ndarray, links: list[np.ndarray], threshold: float, expand: float) -> np.ndarray:
    """Boolean matrix (queries, nodes): visited and similar at least ``threshold``."""
    m, n = len(queries), len(x)
    width = max([1, *(len(a) for a in links)])
    table = np.full((n, width), -1, dtype=np.int64)
    for i, a in enumerate(links):
        table[i, : len(a)] = a
    sims = np.full((m, n), -np.inf)
    opened = np.zeros((m, n), dtype=bool)

    def visit(q: np.ndarray, node: np.ndarray) -> None:
        for i in range(0, len(q), 65536):
            a, b = q[i : i + 65536], node[i : i + 65536]
            sims[a, b] = np.einsum("ij,ij->i", queries[a], x[b])

    def open_(q: np.ndarray, node: np.ndarray) -> None:
        opened[q, node] = True
        for i in range(0, len(q), 32768):
            a, b = q[i : i + 32768], node[i : i + 32768]
            to = table[b]
            flat = (a[:, None] * n + to)[to >= 0]
            flat = flat[np.isneginf(sims.ravel()[flat])]
            flat = np.unique(flat)
            visit(flat // n, flat % n)

    starts = medoids(x)
    visit(np.repeat(np.arange(m), len(starts)), np.tile(starts, m))
    beam = min(BEAM, n)
    active = np.arange(m)
    while len(active):  # greedy: open the best nodes of the beam until all are
        part = sims[active]
        top = np.argpartition(-part, beam - 1, axis=1)[:, :beam]
        value = np.where(opened[active[:, None], top], -np.inf, np.take_along_axis(part, top, axis=1))
        best = np.argsort(-value, axis=1)[:, :4]
        ok = np.take_along_axis(value, best, axis=1) > -np.inf
        rows, cols = np.nonzero(ok)
        open_(active[rows], top[rows, best[rows, cols]])
        active = active[ok.any(axis=1)]
    while True:  # widen: open every node in range
        q, node = np.nonzero((sims >= expand) & ~opened)
        if not len(q):
            return sims >= threshold
        open_(q, node)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row connected to each row by the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (before == label).all():
            return label


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def classes(vectors: DataFrame) -> DataFrame:
    """label, embedding, rep (smallest vec_id) and copies of equal vectors that can
    be linked."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))
        .groupBy("label", F.col("embedding").cast("array<double>").alias("embedding"))
        .agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies"))
    )


def clustered(found: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """``found`` once for each of its nearest clusters, with all of them (near)."""
    n = found.count()
    k = int(max(1, min(MAX_CLUSTERS, -(-n // CLUSTER_ROWS))))
    sample = (
        found.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(min(SAMPLE, max(1024, 64 * k))).collect()
    )  # the documented sample
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["embedding"]), []).append(r["embedding"])
    centers = {d: fit_centroids(_unit(np.array(v, dtype=np.float64)), k) for d, v in by_dim.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for v in batch.column("embedding").to_pylist():
                c = centers.get(len(v))
                if c is None:
                    near.append([0])
                else:
                    s = c @ _unit(np.array([v]))[0]
                    near.append(np.sort(np.argsort(-s, kind="stable")[:overlap]).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"]
            )

    schema = "label int, embedding array<double>, rep long, copies long, near array<int>"
    placed = found.select(F.col("label").cast("int"), "embedding", "rep", "copies").mapInArrow(assign, schema)
    return placed.withColumn("cluster", F.explode("near")).withColumn("dim", F.size("embedding"))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, expand: float = EXPAND, overlap: int = OVERLAP
) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links,
    component_id, kept.

    Equal vectors of a label are one class, compared once; each copy is a link.
    Vectors that are null, zero or hold null or non-finite components, rows
    without label or vec_id, have no links and are their own component. Vectors
    of different lengths are not compared. Links are those the graph search
    finds (see :func:`audit_recall`), none is below ``threshold``.

    A cluster beyond one shard is split; pairs of its parts are searched each in
    a task of its own. Tasks return counts and a spanning forest, not pairs.
    """
    found = write_table(classes(vectors), "classes")
    shards = write_table(clustered(found, overlap), "shards")
    cell = ["label", "dim", "cluster"]
    parts = shards.groupBy(*cell).agg(F.ceil(F.count("*") / SHARD_NODES).cast("int").alias("parts"))
    nodes = write_table(
        shards.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int")), "nodes"
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, cluster, part), group in by_key(batches, *cell, "part"):
            reps = group.column("rep").to_numpy()
            links = robust_prune(_unit(_vectors(group.column("embedding"))), cluster * 1009 + part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, pa.int64()), pa.array([reps[a] for a in links], pa.list_(pa.int64()))], names=["rep", "links"]
            )

    built = (
        nodes.repartition(*cell, "part").sortWithinPartitions(*cell, "part", "rep").mapInArrow(build, "rep long, links array<long>")
    )
    # a vector has one list for each of its clusters, so the union is bounded
    united = built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    dealt = (
        nodes.join(united, "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("a", F.least("part", "other"))
        .withColumn("b", F.greatest("part", "other"))
    )
    block = [*cell, "a", "b"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, cluster, a, b), group in by_key(batches, *block):
            reps, part = group.column("rep").to_numpy(), group.column("part").to_numpy()
            if len(reps) < 2 or (a != b and part.min() == part.max()):
                continue
            x = _unit(_vectors(group.column("embedding")))
            links = group.column("links").to_pylist()
            near, copies = group.column("near").to_pylist(), group.column("copies").to_numpy()
            left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)

            def inside(rows: np.ndarray) -> list[np.ndarray]:
                place = {int(r): k for k, r in enumerate(reps[rows])}
                return [np.array([place[v] for v in links[r] if v in place], dtype=np.int64) for r in rows]

            hits = range_search(x[left], x[right], inside(right), threshold - 1e-9, expand)
            if a == b:
                hits |= hits.T
            else:
                hits |= range_search(x[right], x[left], inside(left), threshold - 1e-9, expand).T
            i, j = np.nonzero(hits)
            i, j = left[i], right[j]
            i, j = i[i != j], j[i != j]
            cos = np.concatenate(
                [np.einsum("ij,ij->i", x[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, max(1, len(i)), 65536)]
            )
            i, j = i[cos >= threshold], j[cos >= threshold]
            # a pair that shares several clusters counts in the first of them
            wide = max(len(c) for c in near)
            home = np.array([c + [-1] * (wide - len(c)) for c in near])
            both = (home[i][:, :, None] == home[j][:, None, :]).any(axis=2) & (home[i] >= 0) & (home[i] < cluster)
            counted = ~both.any(axis=1)
            links_of = np.bincount(i[counted], copies[j[counted]], minlength=len(reps))
            if a != b:
                links_of += np.bincount(j[counted], copies[i[counted]], minlength=len(reps))
            label = _labels(len(reps), i, j)
            root = reps[label]
            some = (links_of > 0) | (root != reps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps[some], pa.int64()), pa.array(root[some], pa.int64()), pa.array(links_of[some].astype(np.int64))],
                names=["u", "v", "links"],
            )

    hits = write_table(
        dealt.repartition(*block).sortWithinPartitions(*block, "rep").mapInArrow(search, "u long, v long, links long"), "hits"
    )
    roots = connected_components(hits.select("u", "v"))
    counts = hits.groupBy("u").agg(F.sum("links").alias("links"))
    named = (
        found.join(counts, F.col("rep") == F.col("u"), "left")
        .join(roots, F.col("rep") == F.col("id"), "left")
        .select(
            F.col("label").alias("l"), F.col("embedding").alias("e"), F.coalesce("root", "rep").alias("root"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        )
    )
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    match = (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull()
    return rows.join(named, match, "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("root", "vec_id")).alias("kept"),
    )


def audit_recall(vectors: DataFrame, result: DataFrame, sample: int = 200, threshold: float = THRESHOLD) -> float:
    """Share of the links of ``sample`` vectors, in the order of a hash, that
    ``result`` counts, against a comparison with all rows of their label."""
    usable = vectors.where("vec_id is not null and label is not null and embedding is not null")
    asked = usable.orderBy(F.xxhash64("vec_id")).limit(sample).collect()
    ids = [r["vec_id"] for r in asked]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(ids, 0)
        for batch in batches:
            for vec_id, label, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
                x = np.array(v, dtype=np.float64)
                for r in asked:
                    if r["vec_id"] != vec_id and r["label"] == label and len(r["embedding"]) == len(x):
                        y = np.array(r["embedding"], dtype=np.float64)
                        norm = np.sqrt((x @ x) * (y @ y))
                        totals[r["vec_id"]] += bool(norm > 0 and x @ y >= threshold * norm)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["vec_id", "n"])

    truth = usable.mapInArrow(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    row = truth.join(result, "vec_id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("found")).first()
    return 1.0 if not row["n"] else row["found"] / row["n"]
