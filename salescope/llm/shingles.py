"""Word shingles and MinHash signatures of whole texts, vectorised over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_MASK = (1 << 64) - 1
#: Odd base of the polynomial word hash, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about so many bytes.
PIECE_BYTES = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, by doubling."""
    out = np.ones(max(1, n), dtype=np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * _U(pow(base, have, 1 << 64))
        have += step
    return out


_CACHE: dict[str, np.ndarray] = {}


def _cached(name: str, base: int, n: int) -> np.ndarray:
    if name not in _CACHE or len(_CACHE[name]) < n:
        _CACHE[name] = _powers(base, max(n, PIECE_BYTES + (PIECE_BYTES >> 1)))
    return _CACHE[name][:n]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per text) of the texts that lie back to back in
    ``data`` (bytes) and end at ``ends``. Words are the runs of bytes that are not
    blank, with A-Z as a-z; the hash of a word is a polynomial over its bytes
    modulo 2^64, mixed with its length."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    word = ~_BLANK[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    first = starts[(starts < ends)]
    begins[first] = word[first]
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    last = ends[(starts < ends)] - 1
    stops[last] = word[last]
    b, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * _cached("base", _BASE, n), out=sums[1:])
        h = (sums[e] - sums[b]) * _cached("inverse", _INVERSE, n)[b]
        h = _mix(h ^ ((e - b).astype(np.uint64) * _U(0x2545F4914F6CDD1D)))
    counts = np.searchsorted(b, ends) - np.searchsorted(b, starts)
    return h, counts


_UNIT = _mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def span_hashes(units: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash, never 0, of each span of 16-bit ``units``: a polynomial over its
    units, mixed with its length. Long spans of a special build can have equal hashes;
    callers take those of bounded length."""
    n = len(units)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_UNIT[units] * _cached("base", _BASE, n), out=sums[1:])
        h = (sums[stops] - sums[begins]) * _cached("inverse", _INVERSE, n)[begins]
        h = _mix(h ^ ((stops - begins).astype(np.uint64) * _U(0x2545F4914F6CDD1D)))
    return np.maximum(h, _U(1))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, shingles per text), repeats included. A text with
    fewer words than ``size`` has its whole sequence as one; without words none."""
    with np.errstate(over="ignore"):
        total = len(words)
        ends = np.cumsum(counts)
        starts = ends - counts
        if total >= size:
            acc = np.zeros(total - size + 1, dtype=np.uint64)
            for k in range(size):
                acc = acc * _U(0xD6E8FEB86659FD93) + words[k : total - size + 1 + k]
            acc = _mix(acc)
        else:
            acc = np.zeros(0, np.uint64)
        per = np.maximum(counts - size + 1, 0)
        owner = np.repeat(np.arange(len(counts)), counts)[: len(acc)]
        valid = np.arange(len(acc)) + size <= ends[owner] if len(acc) else np.zeros(0, bool)
        acc, owner = acc[valid], owner[valid]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            extra = np.empty(len(short), dtype=np.uint64)
            for i, t in enumerate(short):
                h = _U(counts[t] * 0x9E37)
                for x in words[starts[t] : ends[t]]:
                    h = h * _U(0xD6E8FEB86659FD93) + x
                extra[i] = h
            order = np.argsort(np.concatenate([owner, short]), kind="stable")
            acc = np.concatenate([acc, _mix(extra)])[order]
            per[short] = 1
    return acc, per


def pieces(texts: pa.Array):
    """(first row, byte data, ends) for runs of rows of about PIECE_BYTES bytes;
    null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, side="right")) - 1)
        j = min(j, len(texts))
        yield i, data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def shingle_sets(texts: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text, one array per row."""
    for _, data, ends in pieces(texts):
        words, counts = word_hashes(data, ends)
        hashes, per = shingle_hashes(words, counts, size)
        stops = np.cumsum(per)
        for a, b in zip(stops - per, stops, strict=True):
            yield np.unique(hashes[a:b])


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (
        rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
        rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32),
    )


def signatures(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """MinHash signatures (rows: sets, columns: n hash functions), uint32; the
    row of an empty set is all ones."""
    out = np.full((len(sets), n), 0xFFFFFFFF, dtype=np.uint32)
    a, b = coefficients(n, seed)
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 16384):
            total += len(sets[j])
            j += 1
        full = [k for k in range(i, j) if len(sets[k])]
        if full:
            flat = np.concatenate([sets[k] for k in full])
            x = (flat >> _U(32)).astype(np.uint32) ^ flat.astype(np.uint32)
            starts = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
            with np.errstate(over="ignore"):
                for c in range(n):
                    h = x * a[c] + b[c]
                    h ^= h >> np.uint32(15)
                    out[full, c] = np.minimum.reduceat(h, starts)
        i = j
    return out
