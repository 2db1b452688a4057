"""MinHash near-dedup (operator 2) with sequential Bayesian verification.

Signatures are cut into bands; documents that agree in a band are candidates.
Signature batches of a candidate pair are compared one after another: with m of
k hashes equal, the similarity has a Beta(m + 1, k - m + 1) posterior, and the
pair is dropped as soon as the similarity sought has less than the chosen
probability. Survivors are verified on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, connected_components, row_struct, write_table
from .shingles import _mix, shingle_sets, signatures

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= 85 * union.
PERCENT = 85
#: 25 bands of 5: a pair at 0.85 agrees in none with probability 4e-7.
BANDS, ROWS = 25, 5
#: Chance at which a batch may wrongly prune a pair that is similar enough.
MISS = 1e-5
#: Candidates of a component are compared in blocks of so many documents, or
#: shingles, on each side.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 21
#: A table of candidates with at most so many rows (16 bytes each) is broadcast.
BROADCAST_ROWS = 2_000_000
_SEED = 20240


def least_matches(k: int, threshold: float, miss: float) -> int:
    """Fewest equal hashes of k at which P(similarity >= threshold) >= miss. For
    a uniform prior that probability is P(Binomial(k + 1, threshold) <= m)."""
    total = 0.0
    for m in range(k + 1):
        total += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        if total >= miss:
            return m
    return k


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band is part of it."""
    out = np.empty((len(sigs), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sigs), b + 1, dtype=np.uint64)
            for r in range(rows):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, b * rows + r].astype(np.uint64))
            out[:, b] = h
    return out


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (128 bits that tell sets apart; null for empty
    sets) and the band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), words))
            keys = band_keys(signatures(sets, bands * rows, _SEED), bands, rows)
            with np.errstate(over="ignore"):
                k1 = [int(_mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
                k2 = [
                    int(_mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None
                    for s in sets
                ]
            offsets = np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(k1, pa.int64()),
                    pa.array(k2, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel())),
                ],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
    )


class Forest:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


def block_links(
    ids: np.ndarray, side: np.ndarray, texts: pa.Array, words: int, percent: int, bands: int, rows: int, miss: float
) -> list[tuple[int, int]]:
    """Links that connect all documents of a block that are connected by links
    inside it (``side`` constant) or between its two sides."""
    sets = list(shingle_sets(texts, words))
    sigs = signatures(sets, bands * rows, _SEED)
    keys = band_keys(sigs, bands, rows)
    sizes = np.array([len(s) for s in sets])
    batch = rows * max(1, bands // 5)
    stages = [(k, min(k + batch, bands * rows)) for k in range(0, bands * rows, batch)]
    need = {k: least_matches(k, percent / 100, miss) for _, k in stages}
    two = side.min() != side.max()
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    found = []
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        agree = np.zeros((len(part), len(right)), dtype=bool)
        for b in range(bands):
            agree |= keys[part, b][:, None] == keys[right, b][None, :]
        i, j = np.nonzero(agree)
        i, j = part[i], right[j]
        if not two:
            i, j = i[i < j], j[i < j]
        matches = np.zeros(len(i), dtype=np.int64)
        for a, k in stages:
            matches += (sigs[i, a:k] == sigs[j, a:k]).sum(axis=1)
            keep = matches >= need[k]
            i, j, matches = i[keep], j[keep], matches[keep]
        fits = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
        found.append(np.stack([matches[fits], i[fits], j[fits]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    pairs = pairs[np.argsort(-pairs[:, 0], kind="stable")]
    forest, links = Forest(len(ids)), []
    for _, i, j in pairs.tolist():
        if forest.find(i) == forest.find(j):
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            forest.join(i, j)
            links.append((int(ids[i]), int(ids[j])))
    return links


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    words: int = SHINGLE_WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Equal sets are one class. A class is linked to another if ``percent`` of the
    union of their shingles is common. component_id is the smallest doc_id that
    is reachable by links. Texts without words (or null) have no shingles and
    are linked with nothing. Rows that repeat a doc_id are one document of all
    their texts; a null doc_id is never a component's name: such a row is kept
    only if its class has no other id, and its component_id is then null.

    Candidates are connected by their bands first, each band's bucket as a star,
    which is linear however large a bucket is. The texts of a candidate
    component then meet in blocks; a component beyond one block is dealt over
    pairs of blocks, so that no task holds more than two, and each block
    returns a spanning forest of its links, never all pairs.
    """
    sketched = write_table(sketches(docs, words, bands, rows), "sketches")
    classes = write_table(
        sketched.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")).where("rep is not null"),
        "classes",
    )
    reps = sketched.join(classes, ["k1", "k2"]).where("doc_id = rep")
    reps = write_table(reps.select("rep", "n_shingles", "bands"), "reps")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last")
    stars = banded.join(buckets, "band").where("rep <> first").select(F.col("rep").alias("u"), F.col("first").alias("v"))
    near = connected_components(stars)
    members = near.unionAll(near.select(F.col("root").alias("id"), "root").distinct())
    sized = members.join(reps.groupBy("rep").agg(F.max("n_shingles").alias("n")), F.col("id") == F.col("rep"))
    sized = write_table(sized.select("id", "root", "n"), "members")
    blocks = sized.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    dealt = write_table(
        sized.join(blocks, "root")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", "root", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")),
        "dealt",
    )
    # two integers and two longs a row: sent whole only up to a checked number of rows
    if dealt.count() <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(dealt, "id")
    placed = texts.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches, "root", "a", "b"):
            if group.num_rows < 2:
                continue
            links = block_links(
                group.column("id").to_numpy(), group.column("own").to_numpy(), group.column("text"),
                words, percent, bands, rows, miss,
            )
            if links:
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    roots = connected_components(placed.mapInArrow(verify, "u long, v long"))
    named = classes.join(roots, F.col("rep") == F.col("id"), "left").select(
        "k1", "k2", F.coalesce("root", "rep").alias("root")
    )
    component = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    return (
        sketched.drop("bands")
        .join(named, ["k1", "k2"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one for each component. Rows without words
    stay; rows that repeat a kept doc_id count as one. Rows without a doc_id are
    compared like others, but a row with one is preferred to them; those with the
    same text count as one."""
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    # the row as a struct: names of its columns meet none of the helpers'
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("id"), row_struct(docs).alias("row"))
    columns = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    texts = keyed.select(F.col("id").alias("doc_id"), columns[docs.columns.index("text")])
    times = near_duplicates(texts, **options).groupBy(F.col("doc_id").alias("id")).agg(F.count_if("kept").alias("times"))
    times = write_table(times, "kept")
    # the rows with their texts meet the fewer ids, those that stay or the others; one
    # long a row, sent whole only up to a checked number of rows, so texts stay in place
    one = F.col("times") == 1
    stays, goes = (times.where(c).select("id") for c in (one, ~one))
    n_stays, n_goes = times.agg(F.count_if(one), F.count_if(~one)).first()
    ids, n, how = (goes, n_goes, "left_anti") if n_goes <= n_stays else (stays, n_stays, "left_semi")
    stay = keyed.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "id", how)
    more = times.where("times > 1")
    if more.isEmpty():
        return stay.select(*columns)
    # some ids repeat: the first row in column order stays
    first = keyed.join(more, "id").groupBy("id").agg(F.min("row").alias("row"))
    return stay.select(*columns).unionAll(first.select(*columns))
