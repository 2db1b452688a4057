"""Language identification (operator 12) by compression.

Each language has a zstandard raw-content dictionary. A text, folded to its words
in lower case, is encoded with every dictionary; the language whose code, with the
length of its prior, is shortest is chosen, and rejected where the next one is
nearly as short.

A dictionary holds snippets of the learning rows of its language: of all snippets the
ones with the smallest hashes, distinct ones only, up to DICTIONARY_BYTES. So learning
sees every labelled row, a task keeps no more than one dictionary a language, and
copies count once.
"""

from __future__ import annotations

import collections
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Predicted where there is no letter, or no language has been learnt.
UNKNOWN = "und"
#: Bytes of a language's dictionary, in snippets of about so many bytes.
DICTIONARY_BYTES, SNIPPET_BYTES = 1 << 17, 512
#: Languages that are learnt at most: those with the most learning rows.
MOST_LANGUAGES = 256
#: Compression level, and bytes of folded text that are encoded together.
LEVEL, CHUNK_BYTES = 9, 1024
#: A prediction whose code is not shorter than the next by so many bits is rejected.
MARGIN_BITS = 16.0
#: Rows whose crc32(doc_id) has this remainder are not learnt from.
FOLDS, HELD_OUT = 3, 1

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; null ids are not held out, nor learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def folded(text: str | None) -> bytes:
    """The words of a text in lower case, a space after each; words that repeat the one
    before are left out, since they tell nothing new. Empty where there is no letter."""
    if not text:
        return b""
    words = _WORD.findall(text.lower())
    if not any(c.isalpha() for w in words for c in w):
        return b""
    kept = [w for w, before in zip(words, [None, *words], strict=False) if w != before]
    return (" ".join(kept) + " ").encode()


def snippets(data: bytes, size: int) -> Iterator[bytes]:
    """The whole of a folded text in parts of ``size`` bytes or a little more, cut at spaces."""
    start = 0
    while start < len(data):
        end = data.find(b" ", start + size - 1) + 1
        if not end:
            end = len(data)
        yield data[start:end]
        start = end


@dataclass
class Model:
    """Dictionaries and priors (bits) by language."""

    dictionaries: dict[str, bytes]
    priors: dict[str, float]
    level: int = LEVEL
    chunk: int = CHUNK_BYTES

    def compressors(self) -> dict:
        import zstandard

        out = {}
        for lang, data in self.dictionaries.items():
            trained = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=self.level)
            out[lang] = zstandard.ZstdCompressor(
                level=self.level, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        return out


def choose(data: bytes, compressors: dict, priors: dict[str, float], chunk: int) -> tuple[str, float, float]:
    """(language, probability by code lengths, bits to the next language)."""
    if not data or not compressors:
        return UNKNOWN, 0.0, 0.0
    chunks = list(snippets(data, chunk))
    bits = sorted((8 * sum(len(c.compress(x)) for x in chunks) + priors[lang], lang) for lang, c in compressors.items())
    best = bits[0][0]
    score = 1.0 / sum(2.0 ** max(-1000.0, best - b) for b, _ in bits)
    return bits[0][1], score, (bits[1][0] - best if len(bits) > 1 else float("inf"))


def train(
    docs: DataFrame,
    dictionary_bytes: int = DICTIONARY_BYTES,
    snippet_bytes: int = SNIPPET_BYTES,
    most_languages: int = MOST_LANGUAGES,
    level: int = LEVEL,
    chunk: int = CHUNK_BYTES,
) -> Model:
    """Learn from text and lang of the rows of ``docs`` that are not held out, have a
    language and hold a letter. The driver gets ``dictionary_bytes`` a language."""
    keep = max(1, dictionary_bytes // snippet_bytes)
    rows = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each language the snippets with the smallest hashes: a heap with the largest on top
        heaps: dict[str, list] = collections.defaultdict(list)
        held: dict[str, set] = collections.defaultdict(set)
        seen: dict[str, int] = collections.Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                data = folded(text.as_py())
                seen[lang] += bool(data)
                heap, inside = heaps[lang], held[lang]
                for part in snippets(data, snippet_bytes):
                    h = xxhash.xxh64_intdigest(part) >> 1
                    if h in inside or (len(heap) >= keep and h >= -heap[0][0]):
                        continue
                    inside.add(h)
                    if len(heap) < keep:
                        heapq.heappush(heap, (-h, part))
                    else:
                        inside.discard(-heapq.heapreplace(heap, (-h, part))[0])
        for lang, heap in heaps.items():
            columns = [[lang] * len(heap), [-h for h, _ in heap], [p for _, p in heap], [0] * len(heap)]
            columns = [[*c, x] for c, x in zip(columns, (lang, None, None, seen[lang]), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                names=["lang", "h", "part", "seen"],
            )

    found = rows.mapInArrow(least, "lang string, h long, part binary, seen long")
    totals = found.groupBy("lang").agg(F.sum("seen").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    counts = {r["lang"]: r["n"] for r in totals if r["n"]}
    order = Window.partitionBy("lang").orderBy("h")
    chosen = (
        found.where(F.col("h").isNotNull() & F.col("lang").isin([*counts]))
        .dropDuplicates(["lang", "h"])
        .withColumn("at", F.row_number().over(order))
        .where(F.col("at") <= keep)
        .select("lang", "h", "part")
        .toArrow()
    )
    parts: dict[str, list] = collections.defaultdict(list)
    for lang, h, part in zip(*[c.to_pylist() for c in chosen.columns], strict=True):
        parts[lang].append((h, part))
    everyone = sum(counts.values())
    return Model(
        {lang: b"".join(p for _, p in sorted(own)) for lang, own in sorted(parts.items())},
        {lang: -math.log2(counts[lang] / everyone) for lang in parts},
        level,
        chunk,
    )


def predict(docs: DataFrame, model: Model, margin_bits: float = MARGIN_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, margin (bits to the next
    language), rejected.

    ``lang_pred`` is the language with the shortest code, ties by name; ``und``, with
    score and margin 0 and rejected, where the text is null, empty or without a letter, or
    nothing was learnt. ``score`` is the share of its likelihood by code lengths. Narrow
    margins are rejected. Repeated rows count each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # plain values: workers need not know the class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        compressors = known.compressors()
        for batch in batches:
            found = [choose(folded(t.as_py()), compressors, known.priors, known.chunk) for t in batch.column("text")]
            langs, scores, margins = zip(*found, strict=True) if found else ((), (), ())
            margin = np.array(margins, float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(margin), pa.array(margin < margin_bits),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def identify(docs: DataFrame, **options) -> DataFrame:
    """:func:`predict` for every row, with a model learnt from the rows not held out."""
    return predict(docs, train(docs, **options))
