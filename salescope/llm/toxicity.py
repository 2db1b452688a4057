"""Toxicity (operator 8): a weighted lexicon matched by Aho-Corasick.

Texts are folded (case, accents, homoglyphs, digit substitutions), so that
disguised words meet the lexicon. Entries are word beginnings and whole words
that labelled toxic documents hold far more often than others; their weights
are log odds. Matches inside exception phrases do not count. The weights of a
text, normalised by its length, give the score.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

#: At most so many labelled documents are learnt from, in the order of a hash of
#: their ids; the model's size is bounded with it.
MAX_TRAIN = 12_000
#: At most so many lexicon entries, the most telling ones.
MAX_LEXICON = 4_000
#: Every FOLDS-th document, by CRC32 of its id, is held out of learning.
FOLDS = 5
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "sore loser board")
#: Least log odds of a lexicon entry; weaker ones are words of a topic or language.
LEAST_ODDS = 3.5
_SHORTEST, _LONGEST = 3, 10

#: Look-alikes of Latin letters, and digits and signs used for letters; fixed values.
HOMOGLYPHS = dict(
    zip(
        "абеёикмнорстухіјѕԁԛԝαβεικνορτυχ" + "0134578@$",
        "abeeukmhopctyxijsdqwabeiknoptux" + "oieastbas",
        strict=True,
    )
)


class _Fold(dict):
    """str.translate table, filled as characters are met."""

    def __init__(self, accents: bool = True):
        super().__init__()
        self.accents = accents

    def __missing__(self, code: int):
        c = chr(code)
        if c in HOMOGLYPHS:
            out = HOMOGLYPHS[c]
        elif self.accents and c.isalpha() and 0xC0 <= code < 0x250:
            out = c
        else:
            plain = unicodedata.normalize("NFKD", c)
            out = "".join(x for x in plain if x.isalpha()) or (None if unicodedata.combining(c) else " ")
        self[code] = out
        return out


def fold(text: str, table: dict) -> str:
    """Letters only, one space between words and at both ends."""
    return " " + " ".join(text.lower().translate(table).split()) + " "


def grams(word: str) -> Iterator[str]:
    for n in range(_SHORTEST, min(len(word), _LONGEST) + 1):
        yield " " + word[:n]
    if len(word) >= _SHORTEST:
        yield f" {word} "


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float
    slopes: tuple[float, float]

    def automaton(self) -> ahocorasick.Automaton:
        table = _Fold()
        a = ahocorasick.Automaton()
        a.add_word("\0", (0.0, 1))
        for entry, weight in self.lexicon.items():
            a.add_word(entry, (weight, len(entry)))
        for phrase in self.exceptions:
            folded = fold(phrase, table)
            a.add_word(folded, (None, len(folded)))
        a.make_automaton()
        return a


def features(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """(weight per square root of the words, log of the weight). Of the entries
    that begin at one word the heaviest counts; none does inside an exception."""
    best: dict[int, float] = {}
    harmless: list[tuple[int, int]] = []
    for end, (weight, size) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            harmless.append((start, end - 1))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if harmless:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in harmless)}
    total = sum(best.values())
    words = max(1, folded.count(" ") - 1)
    return total / math.sqrt(words), math.log1p(total)


def measured(text: str | None, tables: tuple[dict, dict], automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """The larger features of the text with its accents and without."""
    text = text or ""
    found = features(fold(text, tables[0]), automaton)
    return found if text.isascii() else max(found, features(fold(text, tables[1]), automaton))


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)  # the documented bound; 12 bytes a row
    )
    return write_table(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id"), "training")


def _gram_counts(training: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Fold()
        told: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                told[label].update({g for w in set(fold(text or "", table).split()) for g in grams(w)})
        for label, found in told.items():
            entries = list(found.items())
            for i in range(0, len(entries), 50_000):
                g, n = zip(*entries[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g, pa.string()), pa.array([label] * len(g), pa.int32()), pa.array(n, pa.int64())],
                    names=["gram", "label", "n"],
                )

    return training.mapInArrow(count, "gram string, label int, n long").groupBy("gram").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )


def _surprise(toxic, clean, base: float):
    """Chernoff exponent of seeing so many toxic among the documents of an entry."""
    n = toxic + clean
    share = toxic / n
    rest = 0.0 if clean == 0 else (clean / n) * math.log(clean / n / (1 - base))
    return n * (share * math.log(share / base) + rest) if share > base else 0.0


def _candidates(training: DataFrame, n1: int, n0: int, max_lexicon: int) -> tuple[dict[str, float], int]:
    """Entries whose share of toxic documents is beyond chance however many were
    tried, with their log odds, and how many were tried."""
    counts = write_table(_gram_counts(training).where("toxic >= 3"), "grams")
    tried = max(1, counts.count())
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    base = n1 / (n0 + n1)
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    surprise = (F.col("toxic") + F.col("clean")) * (share * F.log(share / base) + rest)
    odds = F.log((F.col("toxic") + 0.5) / (n1 - F.col("toxic") + 0.5)) - F.log(
        (F.col("clean") + 0.5) / (n0 - F.col("clean") + 0.5)
    )
    rows = (
        counts.where((share > base) & (surprise > math.log(10 * tried)) & (odds > LEAST_ODDS))
        .select("gram", odds.alias("odds"))
        .orderBy(F.desc(surprise), "gram")
        .limit(max_lexicon)
        .collect()
    )
    return {r["gram"]: r["odds"] for r in rows}, tried


def learn_lexicon(training: DataFrame, max_lexicon: int = MAX_LEXICON) -> dict[str, float]:
    """The candidate entries that are beyond chance when each (word before, word
    after) counts once, so that copies of a few documents are not taken for many.
    An entry that begins another, or is begun by one, counts only the documents
    that the entries chosen before, the more telling ones, do not explain."""
    totals = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    odds, tried = _candidates(training, n1, n0, max_lexicon)
    entries = list(odds)
    if not entries:
        return {}

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Fold()
        automaton = ahocorasick.Automaton()
        for k, entry in enumerate(entries):
            automaton.add_word(entry, (k, len(entry)))
        automaton.make_automaton()
        for batch in batches:
            hits, contexts = [], []
            for text in batch.column("text").to_pylist():
                folded, first = fold(text or "", table), {}
                for end, (k, size) in automaton.iter(folded):
                    first.setdefault(k, end - size + 1)
                hits.append(list(first))
                contexts.append([])
                for at in first.values():
                    after = folded.find(" ", at + 1) + 1
                    around = (folded[folded.rfind(" ", 0, at) + 1 : at], folded[after : folded.find(" ", after)])
                    contexts[-1].append(zlib.crc32(" ".join(around).encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(hits, pa.list_(pa.int32())), pa.array(contexts, pa.list_(pa.int64()))],
                names=["label", "hits", "contexts"],
            )

    schema = "label int, hits array<int>, contexts array<long>"
    rows = training.mapInArrow(matches, schema).where("size(hits) > 0").collect()  # max_train rows at most
    toxic: list[dict[int, int]] = [{} for _ in entries]
    clean = [0] * len(entries)
    for at, row in enumerate(rows):
        for k, context in zip(row["hits"], row["contexts"], strict=True):
            if row["label"]:
                toxic[k][at] = context
            else:
                clean[k] += 1
    base, bar = n1 / (n0 + n1), math.log(10 * tried)
    worth = lambda k, docs: _surprise(len({toxic[k][d] for d in docs}), clean[k], base) if docs else 0.0
    chosen: dict[str, float] = {}
    explained: dict[str, set[int]] = {}
    for k in sorted(range(len(entries)), key=lambda k: (-worth(k, toxic[k].keys()), -len(entries[k]), entries[k])):
        entry, docs = entries[k], set(toxic[k])
        for other, known in explained.items():
            if entry.startswith(other) or other.startswith(entry):
                docs -= known
        if worth(k, docs) > bar:
            chosen[entry] = odds[entry]
            explained[entry] = set(toxic[k])
    return chosen


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float]]:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(h, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), (float(w[1]), float(w[2]))


def train(
    docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_lexicon: int = MAX_LEXICON,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """Learn from at most ``max_train`` labelled rows that are not held out. With
    no rows of one class the lexicon is empty and the score is the base rate."""
    training = _training(docs, labels, max_train)
    lexicon = learn_lexicon(training, max_lexicon)
    draft = Model(lexicon, exceptions, 0.0, (0.0, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, automaton = (_Fold(), _Fold(accents=False)), draft.automaton()
        for batch in batches:
            xs = [measured(t, tables, automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in xs], pa.float64()), pa.array([x[1] for x in xs], pa.float64()), batch.column("label")],
                names=["a", "b", "label"],
            )

    rows = training.mapInArrow(measure, "a double, b double, label int").collect()  # max_train rows at most
    rows.sort()
    if not rows:
        return Model({}, exceptions, -4.0, (0.0, 0.0))
    x = np.array([[r["a"], r["b"]] for r in rows])
    y = np.array([float(r["label"]) for r in rows])
    bias, slopes = _fit(x, y)
    return Model(lexicon, exceptions, bias, slopes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted after its own columns, which may not have
    those names. Null and empty texts have the score of a text without matches."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, automaton = (_Fold(), _Fold(accents=False)), model.automaton()
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                a, b = measured(text, tables, automaton)
                z = model.bias + model.slopes[0] * a + model.slopes[1] * b
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[*batch.schema.names, "score", "predicted"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double, predicted int"])
    return docs.mapInArrow(judged, schema)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted. Only
    the text is scored. Repeated rows are scored each; a null doc_id is not held out."""
    model = train(docs, labels, **options)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out().alias("held_out"), "score", "predicted"
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, unchanged."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, automaton = (_Fold(), _Fold(accents=False)), model.automaton()
        for batch in batches:
            stay = []
            for text in batch.column("text").to_pylist():
                a, b = measured(text, tables, automaton)
                stay.append(model.bias + model.slopes[0] * a + model.slopes[1] * b < 0)
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
