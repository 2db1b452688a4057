"""Phrase collocation mining (operator 13) by HAT-trie counting.

A task counts phrases in a trie: below a language, a shallow trie of word ids
whose leaves are hash containers of the words that follow; a container that grows too
large bursts into one container for each next word. When the trie is full, its largest
subtrees are spilled whole as runs sorted by the phrases' hashes, cut into chunks. The
runs of a prefix partition (language and some of the first words) are merged in the
order in which the shuffle sorts their chunks, so a merging task holds no more than the
chunks that overlap; only phrases whose hash has enough occurrences are looked at as
text. Phrases after a first word with many occurrences are dealt over all
partitions by the whole phrase.

Words are counted first, then pairs of frequent words, then longer phrases all of
whose pairs are frequent: no other phrase can be frequent. Which words and pairs are
frequent is sent to the tasks as a Bloom filter of bounded size; what it lets through
by mistake is counted too, and left out by its exact count.
"""

from __future__ import annotations

import collections
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: Fewest occurrences of a candidate, most words of it, phrases reported per language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one around it has this percentage of its occurrences.
INSIDE_PERCENT = 80
#: Language of rows without one.
UNKNOWN = "und"
#: Entries of a task's trie, of a container before it bursts, and of a chunk of a run.
TRIE_ENTRIES, CONTAINER_ENTRIES, CHUNK_ENTRIES = 600_000, 4096, 512
#: Slots of a task's table of words by their bytes, as a power of two, the most bytes of
#: a word in it, and words that are looked up in it together.
SLOT_BITS, SLOT_BYTES, TOGETHER = 19, 15, 1 << 16
#: Words that a task remembers, and bytes of text that it takes at once.
VOCABULARY, SLICE_BYTES = 400_000, 1 << 22
#: Prefix partitions, of a language and first words; first words with at least one in so
#: many of all words are dealt over all of them by the whole phrase.
PARTS, HOT_SHARE = 1024, 2048
#: Bits of a Bloom filter for each entry, at most in all, and probes.
BITS_PER_ENTRY, MOST_BITS, PROBES = 12, 1 << 27, 4

#: A-Z as a-z, the separators of pieces as line feeds, tabs as spaces.
_TABLE = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + b".,;:!?\x0b\x0c\r\t", bytes(range(ord("a"), ord("z") + 1)) + b"\n" * 9 + b" "
)
_BREAK = 0
_U = np.uint64
#: The first 0, 1, ... 8 of eight bytes.
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


# ---- words of texts
class Vocabulary(dict):
    """Ids of words in a task; 0 is the break between pieces. ``slots`` has ids by a
    word's bytes and length, which are compared whole; a word may push another out of it."""

    def __init__(self):
        super().__init__({b"\n": _BREAK})
        self.words = [b"\n"]
        self.slots = np.zeros(1 << SLOT_BITS, [("low", "<u8"), ("high", "<u8"), ("id", "<i8")])
        self._hashes = np.zeros(1, _U)

    def hash_array(self) -> np.ndarray:
        new = self.words[len(self._hashes) :]
        if new:
            self._hashes = np.concatenate([self._hashes, np.array([word_hash(w) for w in new], _U)])
        return self._hashes

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.words)
        self.words.append(word)
        return i


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def slices(text: str, size: int) -> Iterator[bytes]:
    """The text's bytes after folding, cut between words into slices of about ``size``."""
    data = text.encode().translate(_TABLE)
    start = 0
    while len(data) - start > size:
        ends = [e for e in (data.find(b" ", start + size), data.find(b"\n", start + size)) if e >= 0]
        if not ends:
            break
        yield data[start : min(ends)]
        start = min(ends)
    yield data[start:]


def word_ids(data: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """Ids of the words and breaks of folded text. Only words that are not in the
    vocabulary's slots, new, long and rare ones, become strings."""
    raw = np.frombuffer(data + bytes(16), np.uint8)
    line = raw[: len(data)] == ord("\n")
    word = (raw[: len(data)] != ord(" ")) & ~line
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    starts, stops = np.flatnonzero(begins | line), np.flatnonzero(ends | line) + 1
    lengths = stops - starts
    eight = np.ndarray(len(data) + 9, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    out = np.empty(len(starts), np.int64)
    for at in range(0, len(starts), TOGETHER):
        b, n = starts[at : at + TOGETHER], lengths[at : at + TOGETHER]
        low = eight[b] & _FIRST_BYTES[np.minimum(n, 8)]
        high = eight[b + 8 * (n > 8)] & _FIRST_BYTES[np.clip(n - 8, 0, 7)] | (np.minimum(n, 255).astype(_U) << _U(56))
        with np.errstate(over="ignore"):
            slot = (_mixed(low * _U(0x9E3779B97F4A7C15) + high) >> _U(64 - SLOT_BITS)).astype(np.int64)
        held = vocabulary.slots[slot]
        ids, short = held["id"].copy(), n <= SLOT_BYTES
        missing = np.flatnonzero((held["low"] != low) | (held["high"] != high) | ~short)
        spans = zip(b[missing].tolist(), (b + n)[missing].tolist(), strict=True)
        ids[missing] = [vocabulary[data[i:j]] for i, j in spans]
        missing = missing[short[missing]]
        new = np.empty(len(missing), vocabulary.slots.dtype)
        new["low"], new["high"], new["id"] = low[missing], high[missing], ids[missing]
        vocabulary.slots[slot[missing]] = new
        out[at : at + TOGETHER] = ids
    return out


# ---- the filter of frequent words and pairs
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def phrase_hashes(words: list[np.ndarray], lang: str) -> np.ndarray:
    """Hashes of phrases, from the hashes of their first, second, ... words."""
    with np.errstate(over="ignore"):
        out = np.full(len(words[0]), word_hash(lang.encode()), _U)
        for h in words:
            out = _mixed(out * _U(0x9E3779B97F4A7C15) + h)
    return out


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashes >> _U(32)) | _U(1)
    with np.errstate(over="ignore"):
        for k in range(PROBES):
            yield ((hashes + _U(k) * step) & _U(bits - 1)).astype(np.int64)


class Filter:
    """Bloom filter; it may let others through, never keeps an entry back."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in _probes(hashes, len(self.words) * 64):
            out &= (self.words[at >> 6] >> (at & 63).astype(_U)) & _U(1) == 1
        return out


def frequent_filter(frequent: DataFrame) -> Filter:
    """Filter of the phrases of ``frequent`` (lang, phrase). The bits are set by an
    aggregation; the driver gets at most MOST_BITS / 64 numbers, as Arrow columns."""
    n = frequent.count()
    bits = min(MOST_BITS, 1 << max(10, (BITS_PER_ENTRY * n - 1).bit_length()))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_kind = collections.defaultdict(list)
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                words = phrase.encode().split(b" ")
                by_kind[lang, len(words)].append([word_hash(w) for w in words])
            for (lang, _), rows in by_kind.items():
                columns = [np.array(c, _U) for c in zip(*rows, strict=True)]
                at = np.concatenate(list(_probes(phrase_hashes(columns, lang), bits)))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["at"])

    at = frequent.select("lang", "phrase").mapInArrow(positions, "at long")
    table = (
        at.groupBy(F.expr("at div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(bits // 64, _U)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(_U)
    return Filter(words)


# ---- the trie
class Container(dict):
    """A hash container: counts of tails, which are ids or tuples of them."""

    __slots__ = ()

    def count(self, tails: list) -> None:
        get = self.get
        for tail in tails:
            self[tail] = get(tail, 0) + 1


class HatTrie:
    """Counts of phrases: language, id of the first word, then a container of the other
    ids (an id, or a tuple of them); a container of tuples with too many entries bursts
    by the next id."""

    def __init__(self, container: int = CONTAINER_ENTRIES):
        self.container = container
        self.roots: dict[str, dict[int, Container | dict[int, Container]]] = {}
        self.entries = 0

    def add(self, lang: str, columns: list[np.ndarray]) -> None:
        """Count occurrences of phrases, given by their first, second, ... ids."""
        root = self.roots.setdefault(lang, {})
        both = columns[0] << 32 | columns[1]  # ids are far below 2^31
        if len(columns) == 2:
            both = np.sort(both)
            columns = [both >> 32, both & 0xFFFFFFFF]
        else:
            order = np.argsort(both)
            columns = [c[order] for c in columns]
        tails = _tails(columns[1:])
        for first, lo, hi in _equal_runs(columns[0]):
            box = root.get(first)
            if box is None:
                box = root[first] = Container()
            if type(box) is Container:
                before = len(box)
                box.count(tails[lo:hi])
                self.entries += len(box) - before
                if len(box) > self.container and len(columns) > 2:
                    root[first] = kids = {}
                    for tail, n in box.items():
                        rest = tail[1] if len(tail) == 2 else tail[1:]
                        kids.setdefault(tail[0], Container())[rest] = n
                continue
            rests = _tails([c[lo:hi] for c in columns[2:]])
            for second, at, end in _equal_runs(columns[1][lo:hi]):
                kid = box.get(second)
                if kid is None:
                    kid = box[second] = Container()
                before = len(kid)
                kid.count(rests[at:end])
                self.entries += len(kid) - before

    def sizes(self) -> list[tuple[int, str, int]]:
        return [
            (len(box) if type(box) is Container else sum(map(len, box.values())), lang, first)
            for lang, root in self.roots.items()
            for first, box in root.items()
        ]

    def take(self, lang: str, first: int) -> list[tuple[tuple[int, ...], Container]]:
        """Remove a subtree: (ids above a container, the container)."""
        box = self.roots[lang].pop(first)
        boxes = [((first,), box)] if type(box) is Container else [((first, k), kid) for k, kid in box.items()]
        self.entries -= sum(len(kid) for _, kid in boxes)
        return boxes


def _tails(columns: list[np.ndarray]) -> list:
    return columns[0].tolist() if len(columns) == 1 else list(zip(*[c.tolist() for c in columns], strict=True))


def _equal_runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return list(zip(values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True))


#: A chunk: its lowest hash, 32-bit hashes in order, phrases joined by line feeds, 64-bit counts.
_RUN = "lang string, part int, low long, hashes binary, keys binary, counts binary"


def _spilled(trie: HatTrie, keep: int) -> Iterator[tuple[str, list[np.ndarray], np.ndarray]]:
    """(lang, first, second, ... ids, counts) of the largest subtrees, which leave the
    trie until ``keep`` entries are left; phrases of a language and length together."""
    # by language, length of a head and of a tail: heads, sizes of their containers, tails, counts
    found: dict[tuple[str, int, int], tuple[list, list, list, list]] = collections.defaultdict(lambda: ([], [], [], []))
    sizes = trie.sizes()
    if keep:
        sizes.sort(reverse=True)
    for _, lang, first in sizes:
        if trie.entries <= keep:
            break
        for head, box in trie.take(lang, first):
            if len(head) == 1 and type(next(iter(box))) is int:  # pairs: no other tails are with them
                kinds = {1: box}
            else:
                kinds = {}
                for tail, n in box.items():
                    width = 1 if type(tail) is int else len(tail)
                    if width not in kinds:
                        kinds[width] = {}
                    kinds[width][tail] = n
            for width, own in kinds.items():
                heads, held, tails, counts = found[lang, len(head), width]
                heads.append(head)
                held.append(len(own))
                tails.extend(own)
                counts.extend(own.values())
    for (lang, depth, width), (heads, held, tails, counts) in found.items():
        above = np.repeat(np.array(heads, np.int64).reshape(-1, depth), held, axis=0)
        flat = tails if width == 1 else chain.from_iterable(tails)
        below = np.fromiter(flat, np.int64, width * len(tails)).reshape(-1, width)
        yield lang, [*above.T, *below.T], np.array(counts, np.int64)


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of the values from each offset to the next."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _runs(trie: HatTrie, vocabulary: Vocabulary, hot: set[tuple[str, str]], parts: int, keep: int) -> Iterator[pa.RecordBatch]:
    """Spill subtrees as sorted runs: chunks of phrases with their counts, by prefix partition."""
    words = pa.array(vocabulary.words, pa.binary()).cast(pa.string())
    hashes = vocabulary.hash_array()
    for lang, columns, counts in _spilled(trie, keep):
        part = phrase_hashes([hashes[columns[0]]], lang)
        spread = [vocabulary[w.encode()] for own, w in hot if own == lang and w.encode() in vocabulary]
        dealt = np.isin(columns[0], spread)
        part[dealt] = phrase_hashes([hashes[c[dealt]] for c in columns], lang)
        part = (part % _U(parts)).astype(np.int32)
        own = (phrase_hashes([hashes[c] for c in columns], lang) >> _U(32)).astype(np.uint32)
        order = np.argsort((part.astype(_U) << _U(32)) | own)
        phrases = pc.binary_join_element_wise(*[words.take(pa.array(c[order])) for c in columns], " ")
        part, own, counts = part[order], own[order], counts[order]
        first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        place = np.arange(len(part)) - np.repeat(first, np.diff([*first, len(part)]))
        starts = np.flatnonzero(place % CHUNK_ENTRIES == 0)
        for i in range(0, len(starts), 1024):
            at = starts[i : i + 1024]
            lo, hi = int(at[0]), int(starts[i + 1024]) if i + 1024 < len(starts) else len(part)
            offsets = np.append(at, hi) - lo
            keys = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), phrases.slice(lo, hi - lo)), "\n")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(at), pa.string()), pa.array(part[at]), pa.array(own[at], pa.int64()),
                    _packed(own[lo:hi], offsets), keys.cast(pa.binary()), _packed(counts[lo:hi], offsets),
                ],
                names=["lang", "part", "low", "hashes", "keys", "counts"],
            )


class Merge:
    """Chunks of the runs of one prefix partition. Entries are summed by hash first;
    phrases of a hash with fewer than ``least`` occurrences are never made strings."""

    def __init__(self, least: int):
        self.least, self.size = least, 0
        self.chunks: list[tuple[np.ndarray, np.ndarray, bytes, int]] = []

    def add(self, hashes: bytes, keys: bytes, counts: bytes) -> None:
        self.chunks.append((np.frombuffer(hashes, "<u4"), np.frombuffer(counts, "<i8"), keys, 0))
        self.size += len(counts) // 8

    def take(self, below: int) -> Iterator[tuple[str, int]]:
        """Phrases with enough occurrences, of those with a hash below ``below``, which go."""
        ready, self.chunks, chunks = [], [], self.chunks
        for hashes, counts, keys, skip in chunks:
            n = int(np.searchsorted(hashes, below)) if below < 1 << 32 else len(hashes)
            if n:
                ready.append((hashes[:n], counts[:n], keys, skip))
                self.size -= n
            if n < len(hashes):
                self.chunks.append((hashes[n:], counts[n:], keys, skip + n))
        if not ready:
            return
        hashes = np.concatenate([c[0] for c in ready])
        order = np.argsort(hashes)
        groups = np.flatnonzero(np.diff(hashes[order].astype(np.int64), prepend=-1))
        sums = np.add.reduceat(np.concatenate([c[1] for c in ready])[order], groups)
        enough = np.empty(len(hashes), bool)
        enough[order] = np.repeat(sums >= self.least, np.diff([*groups, len(hashes)]))
        found: dict[bytes, int] = {}
        end = 0
        for own, counts, keys, skip in ready:
            at = np.flatnonzero(enough[end : end + len(own)])
            end += len(own)
            if len(at):
                phrases = keys.split(b"\n")
                for k, n in zip((at + skip).tolist(), counts[at].tolist(), strict=True):
                    found[phrases[k]] = found.get(phrases[k], 0) + n
        for phrase, n in found.items():
            if n >= self.least:
                yield phrase.decode(), n


def _counted(rows: Iterator[tuple[str, str, int]], size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str, int]] = []

    def batch():
        langs, phrases, counts = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"]
        )

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _streams(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(lang, folded text to take next); texts of a language follow each other, a break after each."""
    held: dict[str, list[bytes]] = collections.defaultdict(list)
    sizes: dict[str, int] = collections.defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for part in slices(text.as_py(), size):
                held[lang].append(part)
                sizes[lang] += len(part) + 1
                if sizes[lang] >= size:
                    yield lang, b"".join(held.pop(lang))
                    sizes[lang] = 0
            held[lang].append(b"\n")
    for lang, parts in held.items():
        yield lang, b"".join(parts)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def word_counts(texts: DataFrame, limits: dict) -> DataFrame:
    """lang, phrase, f of every word."""
    size, most = limits.get("slice", SLICE_BYTES), limits.get("vocabulary", VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = Vocabulary(), collections.defaultdict(lambda: np.zeros(0, np.int64))

        def found():
            words = pa.array(vocabulary.words, pa.binary()).cast(pa.string())
            for lang, own in counts.items():
                at = np.flatnonzero(own)
                for i in range(0, len(at), 8192):
                    some = at[i : i + 8192]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), words.take(pa.array(some)), pa.array(own[some])],
                        names=["lang", "phrase", "f"],
                    )

        for lang, data in _streams(batches, size):
            ids = word_ids(data, vocabulary)
            new = np.bincount(ids[ids > 0], minlength=len(vocabulary.words))
            new[: len(counts[lang])] += counts[lang]
            counts[lang] = new
            if len(vocabulary.words) > most:
                yield from found()
                vocabulary = Vocabulary()
                counts.clear()
        yield from found()

    return texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _selected(ids: np.ndarray, fresh: int, ok: np.ndarray, lengths: range) -> Iterator[list[np.ndarray]]:
    """First, second, ... ids of the phrases of ``lengths`` words whose pairs are all ``ok``
    and whose last word is one of the ``fresh`` last ones."""
    for n in lengths:
        size = len(ids) - n + 1
        if size <= 0:
            continue
        good = np.ones(size, bool)
        for k in range(n - 1):
            good &= ok[k : k + size]
        good[: max(0, len(ids) - fresh - n + 1)] = False
        at = np.flatnonzero(good)
        if len(at):
            yield [ids[at + k] for k in range(n)]


def phrase_counts(
    texts: DataFrame, passing: Filter, filter_words: int, lengths: range, hot: set[tuple[str, str]], least: int, limits: dict
) -> DataFrame:
    """lang, phrase, f of the phrases of ``lengths`` words with f >= ``least``.
    ``passing`` holds the frequent phrases of ``filter_words`` words (1 or 2)."""
    shared = texts.sparkSession.sparkContext.broadcast(passing.words)
    entries, container = limits.get("entries", TRIE_ENTRIES), limits.get("container", CONTAINER_ENTRIES)
    size, most = limits.get("slice", SLICE_BYTES), limits.get("vocabulary", VOCABULARY)
    reach, parts = lengths[-1] - 1, limits.get("parts", PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(shared.value)
        vocabulary, trie = Vocabulary(), HatTrie(container)
        last: dict[str, np.ndarray] = {}
        for lang, data in _streams(batches, size):
            new = word_ids(data, vocabulary)
            ids = np.concatenate([last.get(lang, np.zeros(0, np.int64)), new])
            last[lang] = ids[-reach:]
            hashes = vocabulary.hash_array()[ids]
            word = ids != _BREAK
            ok = word[:-1] & word[1:]
            if filter_words == 1:
                frequent = known.passes(phrase_hashes([hashes], lang))
                ok &= frequent[:-1] & frequent[1:]
            else:
                ok &= known.passes(phrase_hashes([hashes[:-1], hashes[1:]], lang))
            for columns in _selected(ids, len(new), ok, lengths):
                trie.add(lang, columns)
            if len(vocabulary.words) > most:
                kept = {k: [vocabulary.words[i] for i in v.tolist()] for k, v in last.items()}
                yield from _runs(trie, vocabulary, hot, parts, 0)
                vocabulary = Vocabulary()
                last = {k: np.array([vocabulary[w] for w in v], np.int64) for k, v in kept.items()}
            elif trie.entries > entries:
                yield from _runs(trie, vocabulary, hot, parts, entries // 2)
        yield from _runs(trie, vocabulary, hot, parts, 0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            own, held, limit = None, Merge(least), 0
            for batch in batches:
                for lang, part, low, hashes, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if (lang, part) != own:
                        yield from done(own, held, 1 << 32)
                        own, limit = (lang, part), 4 * CHUNK_ENTRIES
                    elif held.size > limit:  # no chunk to come has a hash below this one's lowest
                        yield from done(own, held, low)
                        limit = 2 * held.size + 4 * CHUNK_ENTRIES
                    held.add(hashes, keys, counts)
            yield from done(own, held, 1 << 32)

        def done(own, held, below):
            for phrase, n in held.take(below):
                yield own[0], phrase, n

        return _counted(rows())

    runs = texts.mapInArrow(run, _RUN).repartition("lang", "part").sortWithinPartitions("lang", "part", "low")
    return runs.mapInArrow(merge, "lang string, phrase string, f long")


# ---- scores
def _joined(words: str, start: str, length: str) -> Column:
    return F.expr(f"array_join(slice({words}, {start}, {length}), ' ')")


def scored(counts: DataFrame, least: int) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every candidate: the phrases of two words
    or more with a >= ``least``; of their cuts the lowest-scoring one, then the first."""
    candidates = counts.where(f"size(words) > 1 AND f >= {int(least)}").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = candidates.select("*", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).select(
        "*", _joined("words", "1", "k").alias("head"), _joined("words", "k + 1", "size(words) - k").alias("tail")
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    # a decimal product: 2000000 * a passes 64 bits for a above 4.6e12
    ratio = F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(2000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(19, 0)) + r)")
    best = (
        cuts.join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct(ratio.cast("long").alias("score"), "k", "l", "r")).alias("b"))
    )
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def covered(counts: DataFrame, least: int) -> DataFrame:
    """lang, phrase, longer: the most occurrences of a longer candidate around a phrase."""
    return (
        counts.where(f"size(words) > 2 AND f >= {int(least)}")
        .select(
            "lang",
            "f",
            F.explode(
                F.expr(
                    "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1),"
                    " i -> array_join(slice(words, i, n), ' '))))"
                )
            ).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )


def collocations(
    docs: DataFrame,
    top: int = TOP,
    least: int = LEAST,
    longest: int = LONGEST,
    inside_percent: int = INSIDE_PERCENT,
    limits: dict | None = None,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (null: empty) are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line
    ends, and those into words at spaces and tabs. A phrase of 2 to ``longest`` words
    with a >= ``least`` occurrences within pieces is a candidate; cut into a first part
    with l and a rest with r occurrences it scores floor(2000000 a / (l + r)), the lowest
    score of its cuts (ties: the shortest first part). Candidates inside a longer one
    with ``inside_percent`` of their occurrences go. n is the number of words of the
    language; rows without a language are of ``und``. Ties in rank go by a, then phrase.
    Languages without a candidate have no rows; repeated rows count each. Other columns
    of ``docs`` are ignored. ``limits`` sets what a task holds: entries and
    container of its trie, vocabulary, slice (bytes); parts, the number of prefix
    partitions; and hot, the fewest occurrences of a first word that is dealt over them.
    """
    limits = limits or {}
    texts = _texts(docs)
    words = write_table(word_counts(texts, limits), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    all_words = words.agg(F.sum("f").alias("n")).first()["n"] or 0
    often = words.where(F.col("f") >= least)
    hot_rows = words.where((F.col("f") * HOT_SHARE >= all_words) & (F.col("f") >= limits.get("hot", 1 << 16))).select("lang", "phrase")
    hot = {(r["lang"], r["phrase"]) for r in hot_rows.collect()}  # at most HOT_SHARE rows
    pairs = write_table(phrase_counts(texts, frequent_filter(often), 1, range(2, 3), hot, least, limits), "pairs")
    found = often.unionAll(pairs)
    if longest > 2:
        found = found.unionAll(phrase_counts(texts, frequent_filter(pairs), 2, range(3, longest + 1), hot, least, limits))
    counts = write_table(found.withColumn("words", F.split("phrase", " ")), "phrases")
    kept = (
        scored(counts, least)
        .join(covered(counts, least), ["lang", "phrase"], "left")
        .where(
            F.col("longer").isNull()
            | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * F.lit(int(inside_percent)))
        )
    )
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = F.pmod(F.xxhash64("phrase"), F.lit(64))  # the first ones of each part hold the first ones of all
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", some).orderBy(*best))).where(F.col("rank") <= top)
    return (
        first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
