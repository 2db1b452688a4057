"""Packing (operator 6) by lexical retrieval.

Documents become token ids. They are dealt into shards by content: a tree of
directions, fitted to a sample, gives each a place, and a shard is a run of
places. Shards are indexed by BM25; a seed document asks its shard's index with
all its terms for unused neighbours, which fill its window greedily. Document
frequencies and lengths are those of all documents.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import byte_level_alphabet
from .common import write_table
from .shingles import span_hashes

WINDOW = 4096
#: Appended to each document.
END_ID = 2
#: Documents of an index shard, on average; at most twice as many, and so many tokens.
SHARD_DOCS, SHARD_TOKENS = 2048, 1 << 22
#: Neighbours that are put in order at first; the others follow when these are used up.
NEIGHBOURS = 64
#: Terms in more than this share of a shard's units are scored by rows of a matrix.
DENSE_SHARE = 0.125
#: Length of a document's vector, documents that the tree is fitted to, fewest of
#: them on each side of a branch, and most branches to a leaf.
WIDTH, SAMPLE_DOCS, LEAST_SAMPLE, DEPTH = 128, 32_768, 16, 11
#: Documents sampled for the limits of a shard, and of all shards at most.
LIMIT_SAMPLE, LIMIT_ROWS = 32, 1 << 20
#: BM25 constants.
K1, B = 1.2, 0.75
#: Words whose ids a worker remembers, and longer ones which it does not.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 64
#: Texts are cut into words together in batches of about so many characters.
BATCH_CHARS = 1 << 18

#: Classes of the characters below U+0250: blank, letter, number, other.
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.array(
    [{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _BLANK if chr(c).isspace() else _OTHER) for c in range(0x250)],
    dtype=np.uint8,
)
#: What the pre-tokenizer's pattern cuts off after an apostrophe (fixed values).
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Texts of these characters only are cut by their classes; U+0130 has a lower
#: case of two characters, and "<|" may begin a special token.
_PLAIN_TEXT = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u012f\\u0131-\\u024f]*\\Z")


def _worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, so that what one task
    has learnt of words serves the next."""
    return vars(sys.modules.setdefault("_salescope_worker", types.ModuleType("_salescope_worker")))


def forget_words() -> None:
    """Free what a worker has learnt of words; the stages after the ids need none of it,
    and workers live on from stage to stage."""
    _worker_store().clear()
    pa.default_memory_pool().release_unused()


def cut_words(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words in lower-case characters below U+0250: runs of
    letters, single numbers, runs of others; an apostrophe that begins a word is one
    with the ending that follows it, and what follows that is a word of its own."""
    kind = _CLASS[units]
    begins = kind != _BLANK
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    stops = kind != _BLANK
    stops[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == _NUMBER)
    quotes = np.flatnonzero(begins & (units == ord("'")))
    for ending in _ENDINGS:
        at = quotes[quotes + len(ending) < len(units)]
        for k, c in enumerate(ending, 1):
            at = at[units[at + k] == ord(c)]
        last = at + len(ending)
        stops[at] = begins[at + 1] = False
        stops[last] = True
        after = last[last + 1 < len(units)] + 1
        begins[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


class WordIds:
    """Ids of words by the words' 64-bit hashes: a hash table of numpy arrays whose
    entries point into one array of ids."""

    SLOTS = 22

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.SLOTS, dtype=np.uint64)
        self.entry = np.zeros(1 << self.SLOTS, dtype=np.int32)
        self.words = self.used = 0
        # both grow by doubling
        self.starts, self.ids = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 18, dtype=np.uint32)

    def __len__(self) -> int:
        return self.words

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, dtype=np.int64)
        slot = (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        rows = np.arange(len(keys))
        while len(rows):
            held = self.keys[slot]
            hit = held == keys[rows]
            out[rows[hit]] = self.entry[slot[hit]]
            on = ~hit & (held != 0)
            rows, slot = rows[on], (slot[on] + 1) & ((1 << self.SLOTS) - 1)
        return out

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Distinct unknown ``keys`` with ``ids``, so many each."""
        entry = np.arange(self.words, self.words + len(keys))
        while self.words + len(keys) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[entry + 1] = self.used + np.cumsum(lengths)
        self.ids[self.used : self.used + len(ids)] = ids
        self.words, self.used = self.words + len(keys), self.used + len(ids)
        slot = (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        rows = np.arange(len(keys))
        while len(rows):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[rows[free]]
            placed = free & (self.keys[slot] == keys[rows])
            self.entry[slot[placed]] = entry[rows[placed]]
            rows, slot = rows[~placed], (slot[~placed] + 1) & ((1 << self.SLOTS) - 1)


class WordTokenizer:
    """Token ids of texts; ids of words are remembered between texts and tasks.

    Words are cut, hashed and looked up by arrays over the characters of many texts;
    only words that are new to the worker reach the tokenizer library's model. Words of
    more than CACHE_CHARS are not looked up.
    """

    def __init__(self, path: str):
        store = _worker_store()
        if path not in store:
            # Spark runs one worker a core; threads of the library would only contend
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            step = json.loads(whole.to_str())["pre_tokenizer"]["pretokenizers"][-1]
            if step["type"] != "ByteLevel" or step["add_prefix_space"] or step["use_regex"]:
                raise ValueError("the vocabulary is not one of words by bytes")
            store[path] = (whole, {b: c for c, b in byte_level_alphabet().items()}, WordIds())
        self.tokenizer, self.alphabet, self.known = store[path]

    def plain(self, text: str) -> bool:
        return bool(_PLAIN_TEXT.match(text)) and "<|" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text))

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids a word, and the ids of all words, which are cut and in lower case."""
        of = self.tokenizer.model.tokenize
        ids = [[t.id for t in of(w if w.isascii() else w.encode().decode("latin-1").translate(self.alphabet))] for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return lengths, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))

    def _plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts back to back, and how many each text has."""
        joined = "\n".join(texts).lower()  # one character for one, and blanks end words
        units = np.frombuffer(joined.encode("utf-16-le"), dtype="<u2")
        if not len(units):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begins, stops = cut_words(units)
        keys = span_hashes(units, begins, stops)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        lengths = stops - begins
        entry = np.where(lengths <= CACHE_CHARS, self.known.find(keys), -1)
        new = np.flatnonzero((entry < 0) & (lengths <= CACHE_CHARS))
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            spans = zip(begins[new[first]].tolist(), stops[new[first]].tolist(), strict=True)
            self.known.add(distinct, *self._ids_of([joined[b:e] for b, e in spans]))
            entry[new] = self.known.find(keys[new])
        known = self.known
        starts, pool = known.starts[: known.words + 1], known.ids[: known.used]
        long = np.flatnonzero(entry < 0)
        if len(long):
            more, ids = self._ids_of([joined[b:e] for b, e in zip(begins[long].tolist(), stops[long].tolist(), strict=True)])
            entry[long] = known.words + np.arange(len(long))
            starts, pool = np.concatenate([starts, known.used + np.cumsum(more)]), np.concatenate([pool, ids])
        each = starts[entry + 1] - starts[entry]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(starts[entry] - upto[:-1], each) + np.arange(upto[-1])]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        return ids, np.diff(upto[np.searchsorted(begins, text_ends)], prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit, END_ID last."""
        end = struct.pack("<I", END_ID)
        out: list = [b""] * len(texts)
        plain, size = [], 0

        def flush():
            ids, counts = self._plain_ids([texts[k] for k in plain])
            raw, at = ids.astype("<u4").tobytes(), 0
            for k, n in zip(plain, (4 * counts).tolist(), strict=True):
                out[k] = raw[at : at + n] + end
                at += n

        for k, text in enumerate(texts):
            if self.plain(text):
                plain.append(k)
                size += len(text)
                if size > BATCH_CHARS:
                    flush()
                    plain, size = [], 0
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out[k] = struct.pack(f"<{len(ids)}I", *ids) + end
        if plain:
            flush()
        return out


def tokenize(docs: DataFrame, tokenizer_path: str, batch_chars: int = 1 << 20) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, END_ID last) of every row;
    null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)

        def out(ids, texts):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokenizer.encode(texts), pa.binary())], names=["doc_id", "ids"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                if size > batch_chars:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield out(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary")


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """id, df, and as id -1 the number of documents and of tokens. Each task counts
    into one array of the vocabulary's size, so few rows are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        df = np.zeros(1 << 16, dtype=np.int64)
        first = np.zeros(1 << 16, dtype=np.int64)
        docs = total = 0
        for batch in batches:
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u4")
                top = int(ids.max(initial=0))
                if top >= len(df):
                    df = np.concatenate([df, np.zeros(top + 1, dtype=np.int64)])
                    first = np.zeros(len(df), dtype=np.int64)
                place = np.arange(len(ids))
                first[ids[::-1]] = place[::-1]
                df[ids[first[ids] == place]] += 1  # each distinct id once
                docs, total = docs + 1, total + len(ids)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([[-1], used]), pa.int64()),
                pa.array(np.concatenate([[docs], df[used]]), pa.int64()),
                pa.array(np.concatenate([[total], np.zeros(len(used), np.int64)]), pa.int64()),
            ],
            names=["id", "df", "total"],
        )

    return tokens.select("ids").mapInArrow(count, "id long, df long, total long").groupBy("id").agg(
        F.sum("df").alias("df"), F.sum("total").alias("total")
    )


class Places:
    """Places of documents in an order in which like ones are near each other.

    A vector is a random projection of the document's BM25 weights. The tree halves
    the sample at each branch along the direction between its two means; below the
    leaves, the signs of the vector go on. Weights, signs and directions are whole
    numbers, so a place does not depend on the order of additions: a task that is
    run again gives the same.
    """

    def __init__(self, idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean
        self.directions = np.zeros((1, WIDTH))
        self.cuts = np.full(1, np.nan)

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        store = _worker_store()
        signs = store.get(("signs", len(self.idf)))
        if signs is None:
            signs = np.random.default_rng(6).integers(0, 2, (len(self.idf), WIDTH), dtype=np.int8).astype(np.float32) * 2 - 1
            store["signs", len(self.idf)] = signs
        out = np.zeros((len(docs), WIDTH))
        for i, ids in enumerate(docs):
            terms, tf = np.unique(ids, return_counts=True)
            weight = self.idf[terms]
            norm = K1 * (1 - B + B * len(ids) / self.mean)
            weight = np.rint(8 * weight * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
            kept = weight > 0
            out[i] = weight[kept] @ signs[terms[kept]]
        return out

    def fit(self, sample: np.ndarray) -> None:
        """Branches in the order of a heap; a cut that is not a number ends a path."""
        size = (1 << DEPTH) - 1
        self.directions, self.cuts = np.zeros((size, WIDTH)), np.full(size, np.nan)
        unit = sample / np.maximum(1e-9, np.linalg.norm(sample, axis=1, keepdims=True))
        rows = {0: np.arange(len(unit))}
        for node in range(size):
            held = rows.pop(node, [])
            if len(held) < 2 * LEAST_SAMPLE:
                continue
            own = unit[held]
            centred = own - own.mean(axis=0)
            along = centred[np.argmax((centred**2).sum(axis=1))]
            for _ in range(8):
                along = centred.T @ (centred @ along)
                along /= max(1e-12, np.linalg.norm(along))
            for _ in range(6):
                upper = own @ along > np.median(own @ along)
                if not upper.any():
                    break
                along = own[upper].mean(axis=0) - own[~upper].mean(axis=0)
                along /= max(1e-12, np.linalg.norm(along))
            along = np.rint(along * 1024)
            side = own @ along
            upper = side > np.median(side)
            if upper.any():
                self.directions[node], self.cuts[node] = along, np.median(side)
                rows[2 * node + 1], rows[2 * node + 2] = held[~upper], held[upper]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The path through the tree, then 32 signs."""
        node, path = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors), dtype=np.int64)
        length = np.sqrt((vectors**2).sum(axis=1))
        for _ in range(DEPTH):
            cut = np.where(node < len(self.cuts), self.cuts[np.minimum(node, len(self.cuts) - 1)], np.nan)
            side = (vectors * self.directions[np.minimum(node, len(self.cuts) - 1)]).sum(axis=1)
            upper = side > cut * length
            path = 2 * path + upper
            node = np.where(np.isnan(cut), len(self.cuts), 2 * node + 1 + upper)
        return (path << 32) | ((vectors[:, :32] > 0) @ (1 << np.arange(31, -1, -1, dtype=np.int64)))


class Shard:
    """A BM25 index over units, runs of ids, of which some get used up."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(units)
        lengths = np.array([len(u) for u in units], dtype=np.float64)
        kept = [u[idf[u] > 0] for u in units]
        owner = np.repeat(np.arange(self.n, dtype=np.int64), [len(k) for k in kept])
        key = np.concatenate(kept).astype(np.int64) * self.n + owner if len(owner) else np.zeros(0, np.int64)
        key, tf = np.unique(key, return_counts=True)
        terms, self.docs = key // self.n, key % self.n
        norm = K1 * (1 - B + B * lengths[self.docs] / mean)
        self.score = idf[terms] * tf * (K1 + 1) / (tf + norm)
        # rows are grouped by term, the k-th term has the rows from term_at[k] on
        self.term_at = np.flatnonzero(np.diff(terms, prepend=-1, append=-1))
        counts = np.diff(self.term_at)
        self.term = np.repeat(np.arange(len(counts)), counts)
        self.by_doc = np.argsort(self.docs, kind="stable")
        self.doc_at = np.searchsorted(self.docs[self.by_doc], np.arange(self.n + 1))
        common = counts > max(1, DENSE_SHARE * self.n)
        self.dense_of = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), self.n), dtype=np.float32)
        rows = np.flatnonzero(common[self.term]) if len(counts) else np.zeros(0, np.int64)
        self.dense[self.dense_of[self.term[rows]], self.docs[rows]] = self.score[rows]

    def scores(self, unit: int) -> np.ndarray:
        """BM25 of every unit for all terms of ``unit``."""
        terms = self.term[self.by_doc[self.doc_at[unit] : self.doc_at[unit + 1]]]
        place = self.dense_of[terms]
        out = self.dense[place[place >= 0]].sum(axis=0, dtype=np.float64)
        rare = terms[place < 0]
        if len(rare):
            parts = [slice(a, b) for a, b in zip(self.term_at[rare], self.term_at[rare + 1], strict=True)]
            docs = np.concatenate([self.docs[p] for p in parts])
            out += np.bincount(docs, np.concatenate([self.score[p] for p in parts]), minlength=self.n)
        return out

    def ranked(self, unit: int, used: np.ndarray) -> Iterator[int]:
        """Unused units with terms of ``unit``, the highest scores first, to the last one."""
        scores = self.scores(unit)
        scores[used] = 0
        found = np.flatnonzero(scores > 0)
        size = NEIGHBOURS
        while len(found):
            best = found
            if size < len(found):
                least = np.partition(scores[found], len(found) - size)[len(found) - size]
                best = found[scores[found] >= least]  # with all of equal score
                found = found[scores[found] < least]
            else:
                found = found[:0]
            yield from best[np.lexsort((best, -scores[best]))].tolist()
            size *= 4

    def neighbours(self, unit: int, used: np.ndarray) -> list[int]:
        return list(self.ranked(unit, used))


def pack_shard(
    docs: list[tuple[int | None, np.ndarray]], idf: np.ndarray, mean: float, window: int
) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length), that hold every id of
    ``docs`` once. All are full but the last ones, whose lengths are powers of two.

    A document's whole windows are sequences of their own; its rest is a unit.
    The longest unused unit is a seed; its neighbours, in order of score, follow
    to the last that shares a term, then the longest unused units. What does not fit is cut, and the rest
    of it seeds the next window.
    """
    units: list[tuple[int, int, int]] = []
    for d, (_, ids) in enumerate(docs):
        whole = len(ids) - len(ids) % window
        for start in range(0, whole, window):
            yield [(d, start, window)]
        if whole < len(ids):
            units.append((d, whole, len(ids) - whole))
    if not units:
        return
    shard = Shard([docs[d][1][s : s + n] for d, s, n in units], idf, mean)
    used = np.zeros(len(units), dtype=bool)
    order = iter(sorted(range(len(units)), key=lambda u: (-units[u][2], u)))
    current: list[tuple[int, int, int]] = []
    room = window
    waiting: Iterator[int] = iter(())
    while True:
        unit = next((u for u in waiting if not used[u]), None)
        if unit is None:
            unit = next((u for u in order if not used[u]), None)
            if unit is None:
                break
            asked = True
        else:
            asked = False
        used[unit] = True
        d, start, length = units[unit]
        if not current or asked:
            waiting = shard.ranked(unit, used)
        while length:
            n = min(length, room)
            current.append((d, start, n))
            start, length, room = start + n, length - n, room - n
            if not room:
                yield current
                current, room = [], window
                if length:
                    waiting = shard.ranked(unit, used)  # the rest is the next seed
                else:
                    waiting = iter(())
    # what is left is cut at powers of two, so that nothing is padded
    left = window - room
    while left:
        size = 1 << (left.bit_length() - 1)
        part, need = [], size
        while need:
            d, start, length = current[0]
            n = min(length, need)
            part.append((d, start, n))
            need -= n
            if n == length:
                current.pop(0)
            else:
                current[0] = (d, start + n, length - n)
        yield part
        left -= size


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fitted_places(tokens: DataFrame, idf: np.ndarray, mean: float, n: int) -> Places:
    places = Places(idf, mean)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.vectors([np.frombuffer(raw.as_buffer(), dtype="<u4") for raw in batch.column("ids")])
            yield pa.RecordBatch.from_arrays([pa.array([v.astype("<f4").tobytes() for v in found], pa.binary())], names=["v"])

    sample = tokens.select("ids").sample(min(1.0, SAMPLE_DOCS / max(1, n)), seed=6).mapInArrow(project, "v binary").collect()
    if sample:
        places.fit(np.array([np.frombuffer(r["v"], dtype="<f4") for r in sample], dtype=np.float64))
    return places


def in_order(first: np.ndarray, second: np.ndarray, places: np.ndarray, uids: np.ndarray) -> np.ndarray:
    """How many of the sorted pairs (``first``, ``second``) are at or before each (place, uid)."""
    low, high = np.searchsorted(first, places, "left"), np.searchsorted(first, places, "right")
    for a in np.unique(low[low < high]):
        rows = np.flatnonzero((low == a) & (low < high))
        low[rows] += np.searchsorted(second[a : high[rows[0]]], uids[rows], "right")
    return low


def shard_limits(sample: np.ndarray, shards: int) -> np.ndarray:
    """First (place, uid) of each shard but the first, from rows of (place, uid,
    tokens): each shard gets an equal part of documents and tokens, half and half, so
    at most twice the mean of either."""
    if not len(sample):
        return np.zeros((0, 2), dtype=np.int64)
    sample = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    weight = 1 / len(sample) + sample[:, 2] / max(1, sample[:, 2].sum())
    at = np.searchsorted(np.cumsum(weight), 2 * np.arange(1, shards) / shards)
    return sample[np.unique(np.minimum(at, len(sample) - 1)), :2]


def dealt(tokens: DataFrame, idf: np.ndarray, mean: float, n: int, shards: int) -> DataFrame:
    """The rows of ``tokens`` with shard, place, and uid, which tells equal places
    apart. The limits of shards come from a sample of their own, so that places of all
    rows are found once, on the way to the shuffle."""
    places = fitted_places(tokens, idf, mean, n)
    numbered = tokens.select("doc_id", "ids", F.monotonically_increasing_id().alias("uid"))

    def of(batch: pa.RecordBatch) -> np.ndarray:
        return places.of(places.vectors([np.frombuffer(raw.as_buffer(), dtype="<u4") for raw in batch.column("ids")]))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([of(batch), batch.column("uid").to_numpy(), [len(raw.as_buffer()) // 4 for raw in batch.column("ids")]])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows.T], names=["place", "uid", "size"])

    share = min(LIMIT_ROWS, LIMIT_SAMPLE * shards) / max(1, n)
    limits = np.zeros((0, 2), dtype=np.int64)
    if shards > 1:
        sample = numbered.select("ids", "uid").sample(min(1.0, share), seed=7).mapInArrow(locate, "place long, uid long, size long")
        limits = shard_limits(np.column_stack([c.to_numpy() for c in sample.toArrow().columns]).astype(np.int64), shards)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = of(batch)
            shard = in_order(limits[:, 0], limits[:, 1], found, batch.column("uid").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.int64()), pa.array(shard, pa.int64())],
                names=["doc_id", "ids", "uid", "place", "shard"],
            )

    return numbered.mapInArrow(find, "doc_id long, ids binary, uid long, place long, shard long")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` (doc_id, text) is packed, repeated rows each; null text
    is empty and has the end id only. Sequences have at most ``window`` ids. The
    tokens are written once and shuffled once, by shards, which are ranges of their
    places; rows of equal place, as copies have, are split by uid. A neighbour in another shard is not
    found. Document frequencies are one row for each id and task; their table is as
    large as the tokenizer's vocabulary, which bounds what is sent to the tasks.
    """
    tokens = write_table(tokenize(docs, tokenizer_path), "tokens")
    counts = document_frequencies(tokens).collect()  # one row for each id of the vocabulary
    about = next((r for r in counts if r["id"] == -1), None)
    n, total = (about["df"], about["total"]) if about else (0, 0)
    df = np.zeros(max([0, *(r["id"] for r in counts)]) + 1, dtype=np.float64)
    for r in counts:
        if r["id"] >= 0:
            df[r["id"]] = r["df"]
    # an id of one document has no neighbours
    idf = np.where(df > 1, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0)
    mean = max(1.0, total / max(1, n))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36

        def flush(held):
            nonlocal sequence
            rows = []
            for pieces in pack_shard(held, idf, mean, window):
                offset = 0
                for d, start, length in pieces:
                    doc_id, ids = held[d]
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    rows.append((doc_id, start, length, crc, len(ids), sequence, offset))
                    offset += length
                sequence += 1
            names = [c.split()[0] for c in PIECES.split(", ")]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        held, size, current = [], 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids"))
            for shard, doc_id, raw in zip(*columns, strict=True):
                if shard != current and held:
                    yield flush(held)
                    held, size = [], 0
                current = shard
                held.append((doc_id, np.frombuffer(raw, dtype="<u4")))
                size += len(raw) // 4
                if len(held) >= 2 * SHARD_DOCS or size >= SHARD_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    shards = max(1, math.ceil(n / SHARD_DOCS), math.ceil(2 * total / SHARD_TOKENS))
    near = dealt(tokens, idf, mean, n, shards).repartition(shards, "shard").sortWithinPartitions("shard", "place", "uid")
    return near.select("shard", "doc_id", "ids").mapInArrow(packed, PIECES)
