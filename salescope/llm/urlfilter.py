"""URL filters (operator 3): a Bloom filter cascade.

A URL has as many candidate keys as the list has key shapes (number of host
labels, length of path). Level 0 of a cascade encodes the listed keys, level 1
the keys of the corpus's universe that level 0 wrongly accepts, level 2 the
listed keys that level 1 wrongly accepts, and so on until nothing is wrong. For
every key of the universe the answer is then exact, by hashing alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import write_table

#: (verdict, host, path); fixed by contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The verdict where no key is listed.
DEFAULT_VERDICT = "allow"
#: A cascade is sent to all tasks; beyond so many bytes membership is joined.
MAX_FILTER_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(
        F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit("")
    )


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys that could be listed for a URL: the last ``labels`` labels of the
    host and the first ``length`` characters of the path, for each shape; the
    longest first. Hosts and paths too short for a shape have no key of it."""
    keys = []
    for labels, length in shapes:
        fits = (F.length(path) >= length) & (F.length(host) > 0)
        if labels > 1:
            fits &= F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= labels - 1
        keys.append(F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length))))
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*keys)))) if not keys else F.array_sort(
        F.array_distinct(F.array_compact(F.array(*keys))),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, F.lit(1)).when(a > b, F.lit(-1)).otherwise(F.lit(0)),
    )


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: np.ndarray  # uint64

    def holds(self, h: np.ndarray) -> np.ndarray:
        """For 64-bit hashes of keys: whether the filter accepts them."""
        at = _positions(h, self.bits, self.hashes, self.seed)
        hit = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        return hit.all(axis=1) if len(h) else np.zeros(0, bool)


def _positions(h: np.ndarray, bits: int, hashes: int, seed: int) -> np.ndarray:
    h = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        y = (x * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        y ^= (y >> np.uint64(29)) << np.uint64(1)
        steps = np.arange(hashes, dtype=np.uint64)
        return (x[:, None] + steps * y[:, None]) % np.uint64(bits)


def _level(keys: DataFrame, n: int, fp_rate: float, seed: int) -> Level:
    """A filter of the hashes in ``keys`` (h). Tasks set bits in words of 64, words
    are merged by a grouped OR, and the words, at most ``bits / 64`` rows, come
    to the driver; their number is checked by the caller."""
    bits = max(64, math.ceil(n * -math.log(fp_rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2)))

    def words(frames):
        for frame in frames:
            at = _positions(frame["h"].to_numpy().view(np.uint64), bits, hashes, seed).ravel()
            yield pd.DataFrame(
                {
                    "word": (at >> np.uint64(6)).astype(np.int64),
                    "mask": (np.uint64(1) << (at & np.uint64(63))).view(np.int64),
                }
            )

    found = keys.mapInPandas(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()
    array = np.zeros((bits + 63) // 64, dtype=np.uint64)
    for row in found:
        array[row["word"]] = np.uint64(row["mask"] & (1 << 64) - 1)
    return Level(bits, hashes, seed, array)


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> list[Level] | None:
    """The levels for ``listed`` (key) against ``universe`` (key, distinct), or None
    if they would exceed ``max_bytes``.

    The rate of false positives of level 0 is chosen so that about as many keys
    pass wrongly as are listed; every further level halves what is left. So the
    size follows the list and only the logarithm of the universe.
    """
    hashed = lambda df: df.select("key", F.xxhash64("key").alias("h"))
    inside = write_table(hashed(listed.select("key").distinct()), "listed")
    n, others = inside.count(), universe.count()
    if not n:
        return []
    outside = hashed(universe).join(inside.select("key"), "key", "left_anti")
    rate = min(0.5, n / math.sqrt(2) / max(1, others))
    if n * -math.log(rate) / math.log(2) ** 2 / 8 * 2 > max_bytes:
        return None
    levels: list[Level] = []
    encoded, against = inside, outside
    while True:
        levels.append(_level(encoded, n, rate, len(levels)))
        wrong = write_table(_accepted(against, levels[-1]), "wrong")
        n = wrong.count()
        if not n:
            return levels
        if sum(x.bits for x in levels) / 8 + n > max_bytes:
            return None
        encoded, against, rate = wrong, encoded, 0.5


def _accepted(keys: DataFrame, level: Level) -> DataFrame:
    def passing(frames):
        for frame in frames:
            yield frame[level.holds(frame["h"].to_numpy().view(np.uint64))]

    return keys.mapInPandas(passing, "key string, h long")


def member(levels: list[Level], h: np.ndarray) -> np.ndarray:
    """Exact membership of hashes from the universe: the first level that rejects
    decides; a key rejected by an even level is not listed, by an odd one is."""
    answer = np.full(len(h), len(levels) % 2 == 1)
    open_ = np.arange(len(h))
    for i, level in enumerate(levels):
        hit = level.holds(h[open_])
        answer[open_[~hit]] = i % 2 == 1
        open_ = open_[hit]
    return answer


def judge(
    pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, max_bytes: int = MAX_FILTER_BYTES
) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` (verdict, host, path): a rule fits its host and all subdomains where
    the path starts with its path; the longest fitting rule decides, and
    ``default`` where none fits. Keys listed as allow and as block count as block.
    A null url, or one without "://", has an empty host and path and no rule.
    Repeated rows are judged each.
    """
    keyed = rules.select("verdict", F.concat("host", "path").alias("key"), *(
        x.alias(n) for n, x in (
            ("labels", F.size(F.split("host", "\\."))), ("length", F.length("path")))
    ))
    shapes = [(r["labels"], r["length"]) for r in keyed.select("labels", "length").distinct().collect()]
    shapes.sort(reverse=True)
    # the parts are columns of their own before the keys refer to them often
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    asked = parts.select("page_id", "host", "path", candidate_keys(F.col("host"), F.col("path"), shapes).alias("keys"))
    universe = write_table(asked.select(F.explode("keys").alias("key")).distinct(), "universe")
    lists = {v: keyed.where(F.col("verdict") == v).select("key").distinct() for v in ("block", "allow")}
    lists["allow"] = lists["allow"].join(lists["block"], "key", "left_anti")
    cascades = {v: build_cascade(universe, df, max_bytes) for v, df in lists.items()}
    if any(levels is None for levels in cascades.values()):
        return _joined(asked, lists, default)

    blocked = _answers(cascades["block"])
    allowed = _answers(cascades["allow"])
    told = asked.withColumn("h", F.transform("keys", lambda k: F.xxhash64(k))).withColumns(
        {"block": blocked("h"), "allow": allowed("h")}
    )
    first = F.get(
        F.filter(
            F.zip_with(
                "keys",
                F.arrays_zip("block", "allow"),
                lambda k, m: F.struct(
                    k.alias("key"), F.when(m["block"], F.lit("block")).when(m["allow"], F.lit("allow")).alias("verdict")
                ),
            ),
            lambda s: s["verdict"].isNotNull(),
        ),
        F.lit(0),
    )
    return told.withColumn("hit", first).select(
        "page_id",
        "host",
        "path",
        F.col("hit.key").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )


def _answers(levels: list[Level]):
    """A vectorised function from arrays of key hashes to arrays of answers."""

    @F.pandas_udf("array<boolean>")
    def answers(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in hashes]) if sizes.sum() else np.zeros(0, np.int64)
        told = member(levels, flat.view(np.uint64))
        return pd.Series(np.split(told, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    return answers


def _joined(asked: DataFrame, lists: dict[str, DataFrame], default: str) -> DataFrame:
    """The same answers by a join, for lists whose cascade is too large to send."""
    listed = lists["block"].withColumn("verdict", F.lit("block")).unionAll(
        lists["allow"].withColumn("verdict", F.lit("allow"))
    )
    numbered = write_table(asked.withColumn("_uid", F.monotonically_increasing_id()), "asked")
    best = (
        numbered.select("_uid", F.posexplode("keys").alias("at", "key"))
        .join(listed, "key")
        .groupBy("_uid")
        .agg(F.min(F.struct("at", "key", "verdict")).alias("hit"))
    )
    return numbered.join(best, "_uid", "left").select(
        "page_id", "host", "path", F.col("hit.key").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )


def rules_frame(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")
