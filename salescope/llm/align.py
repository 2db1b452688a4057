"""Cross-tokenizer alignment (operator 11) by divide and conquer at shared cuts.

A text is encoded by two tokenizers. Byte offsets where tokens of both end are
shared cuts. An interval of text that ends at a cut is halved at a common end near
its middle, found by bisecting the other tokenizer's ends, and both halves go on; an
interval without a common end inside is a leaf group. All intervals of a batch are
halved in the same step.

Long texts are cut before they are encoded, at spaces that follow something else:
no token of either tokenizer goes on over such a place, so the ids are those of the
whole text, and a task's memory does not grow with a text's length.

How many documents hold a pair of ids linked is counted over the corpus. A run of
rows (a block) has one dictionary of its pairs, so the shuffle carries one row
per pair and block, and the documents' pairs as positions in that dictionary. The
counts come back to the block by its number, dictionary first.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

#: Characters of a piece of a long text, and of texts that are aligned together.
PIECE_CHARS, BATCH_CHARS = 1 << 16, 1 << 19
#: Pairs of a block, repeats in its documents included.
BLOCK_PAIRS = 1 << 21
#: Pairs of a dictionary row.
CHUNK = 1 << 12
_SAFE_CUT = re.compile(r"(?<=[^\s▁]) (?=.)", re.DOTALL)


# ---- the two tokenizers
def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, U+0100 onwards for the others in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: The pre-tokenizer's pattern of byte-level vocabularies (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every version of Unicode puts in the same classes.
_SETTLED = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u024f]*\Z")


class ByteTokenizer:
    """A byte-level vocabulary; strings of special tokens inside texts are plain text.

    Where the vocabulary's merges are in the order of its ids, tiktoken gives the same
    ids as the tokenizer library, several times as fast; it takes texts of settled
    characters and of no more than ``2 * PIECE_CHARS``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes[i] = bytes(alphabet[c] for c in token)
        spec = json.loads(self.model.to_str())
        self.fast = self._ranked(spec) if spec["normalizer"] is None else None

    def _ranked(self, spec: dict):
        import tiktoken

        steps, merges, vocabulary = spec["pre_tokenizer"], spec["model"]["merges"], spec["model"]["vocab"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        plain = steps["type"] == "ByteLevel" and steps["use_regex"] and not steps["add_prefix_space"]
        special = {t["id"] for t in spec["added_tokens"]}
        if not plain or made != sorted(made) or len(made) + 256 != len(set(vocabulary.values()) - special):
            return None
        ranks = {x: i for i, x in enumerate(self.bytes) if x and i not in special}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if self.fast and len(text) <= 2 * PIECE_CHARS and _SETTLED.match(text):
                out[k] = self.fast.encode_ordinary(text)
            else:
                rest.append(k)
        for k, e in zip(rest, self.model.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out


class PieceTokenizer:
    """A sentence-piece vocabulary, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def text_pieces(text: str, piece_chars: int = PIECE_CHARS) -> list[str]:
    """Space and text, cut into pieces of about ``piece_chars`` characters, each with
    a space in front; one piece where there is no place to cut."""
    text = " " + text
    out, start = [], 0
    while len(text) - start > piece_chars:
        cut = _SAFE_CUT.search(text, start + piece_chars)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


# ---- shared cuts
def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B) before the end of each leaf group, ascending.

    ``a_ends`` and ``b_ends`` are ascending byte offsets over several texts laid end to
    end; ``a_stops`` and ``b_stops`` the tokens before the end of each text, where
    both tokenizers end. An interval tries the ends of A around its middle, twice as
    many in each step, and takes the one nearest to the middle that is an end of B.
    """
    lo_a, hi_a = np.concatenate([[0], a_stops[:-1]]), a_stops.copy()
    lo_b, hi_b = np.concatenate([[0], b_stops[:-1]]), b_stops.copy()
    width = np.ones(len(lo_a), np.int64)
    leaves_a, leaves_b = [], []
    while len(lo_a):
        # the last end of an interval is shared; those before it may be
        inner = hi_a - 1 - lo_a
        middle = lo_a + (inner >> 1)
        first = np.maximum(lo_a, middle - (width >> 1))
        last = np.minimum(hi_a - 1, first + width)
        tries = np.where((inner > 0) & (hi_b - lo_b > 1), np.maximum(last - first, 0), 0)
        owner = np.repeat(np.arange(len(lo_a)), tries)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(tries) - tries, tries) + first[owner]
        where = np.searchsorted(b_ends, a_ends[at])  # bisect
        hit = (where < hi_b[owner] - 1) & (b_ends[np.minimum(where, len(b_ends) - 1)] == a_ends[at])
        owner, at, where = owner[hit], at[hit], where[hit]
        order = np.lexsort((np.abs(at - middle[owner]), owner))
        owner, at, where = owner[order], at[order], where[order]
        nearest = np.ones(len(owner), bool)
        nearest[1:] = owner[1:] != owner[:-1]
        owner, at, where = owner[nearest], at[nearest] + 1, where[nearest] + 1
        found = np.zeros(len(lo_a), bool)
        found[owner] = True
        done = ~found & ((tries == 0) | ((first == lo_a) & (last == hi_a - 1)))
        leaves_a.append(hi_a[done])
        leaves_b.append(hi_b[done])
        wider = ~found & ~done
        lo_a, hi_a, lo_b, hi_b, width = (
            np.concatenate([lo_a[wider], lo_a[owner], at]),
            np.concatenate([hi_a[wider], at, hi_a[owner]]),
            np.concatenate([lo_b[wider], lo_b[owner], where]),
            np.concatenate([hi_b[wider], where, hi_b[owner]]),
            np.concatenate([width[wider] * 2, np.ones(2 * len(owner), np.int64)]),
        )
    a, b = np.concatenate(leaves_a), np.concatenate(leaves_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _digits(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each) of the ids in decimal, each behind its mark."""
    width = max(1, len(str(int(ids.max(initial=0)))))
    out = np.empty((len(ids), width + 1), np.uint8)
    out[:, 0] = marks
    rest = ids.astype(np.int64)
    for k in range(width, 0, -1):
        out[:, k] = 48 + rest % 10
        rest //= 10
    digits = np.ones(len(ids), np.int64)
    for k in range(1, width):
        digits += ids >= 10**k
    kept = np.arange(width + 1)[None, :] > width - digits[:, None]
    kept[:, 0] = True
    return out[kept], digits + 1


class Aligner:
    """Aligns texts in batches and gathers what each document holds."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokenizer(a_path), PieceTokenizer(b_path)
        self.a_len = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b.bytes], np.int64)

    def align(self, owners: list[int], pieces: list[str], docs: dict[int, _Document]) -> None:
        """Add the pieces of texts to the documents that own them, in their order."""
        a_ids, b_ids = self.a.encode(pieces), self.b.encode(pieces)
        kept = []
        for k, (owner, piece) in enumerate(zip(owners, pieces, strict=True)):
            raw = piece.encode()
            if b"".join(map(self.a.bytes.__getitem__, a_ids[k])) == raw == b"".join(map(self.b.bytes.__getitem__, b_ids[k])):
                kept.append(k)
            else:
                docs[owner].broken = True
        if not kept:
            return
        a = np.concatenate([np.array(a_ids[k], np.int64) for k in kept])
        b = np.concatenate([np.array(b_ids[k], np.int64) for k in kept])
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_stops = np.cumsum([len(a_ids[k]) for k in kept])
        b_stops = np.cumsum([len(b_ids[k]) for k in kept])
        cut_a, cut_b = shared_cuts(a_ends, b_ends, a_stops, b_stops)

        # the tokens of a group, A's then B's, in the order in which groups are written
        before_a = np.concatenate([[0], cut_a[:-1]])
        before_b = np.concatenate([[0], cut_b[:-1]])
        group_a = np.repeat(np.arange(len(cut_a)), cut_a - before_a)
        group_b = np.repeat(np.arange(len(cut_b)), cut_b - before_b)
        ids = np.empty(len(a) + len(b), np.int64)
        marks = np.full(len(ids), ord(","), np.uint8)
        ids[np.arange(len(a)) + before_b[group_a]] = a
        ids[np.arange(len(b)) + cut_a[group_b]] = b
        marks[before_a + before_b] = ord(";")
        marks[cut_a + before_b] = ord("|")
        written, sizes = _digits(ids, marks)
        upto = np.concatenate([[0], np.cumsum(sizes)])

        # links: the tokens of B from the one that holds a token's first byte to the one that holds its last
        first = np.searchsorted(b_ends, a_ends - self.a_len[a], side="right")
        last = np.searchsorted(b_ends, a_ends, side="left")
        links = last - first + 1
        who = np.repeat(np.arange(len(a)), links)
        other = np.arange(len(who)) - np.repeat(np.cumsum(links) - links, links) + first[who]
        code = a[who] * self.b.size + b[other]

        owner_of = np.array([owners[k] for k in kept])
        runs = np.flatnonzero(np.concatenate([[True], owner_of[1:] != owner_of[:-1]]))
        runs_end = np.concatenate([runs[1:], [len(owner_of)]]) - 1
        link_stops = np.cumsum(links)
        for s, e in zip(runs.tolist(), runs_end.tolist(), strict=True):
            doc = docs[int(owner_of[s])]
            a0, a1 = (int(a_stops[s - 1]) if s else 0), int(a_stops[e])
            b0, b1 = (int(b_stops[s - 1]) if s else 0), int(b_stops[e])
            l0, l1 = (int(link_stops[a0 - 1]) if a0 else 0), int(link_stops[a1 - 1])
            doc.n_a += a1 - a0
            doc.n_b += b1 - b0
            doc.n_groups += int(np.searchsorted(cut_a, a1, side="right") - np.searchsorted(cut_a, a0, side="right"))
            doc.write(written[upto[a0 + b0] : upto[a1 + b1]].tobytes())
            doc.add_pairs(*np.unique(code[l0:l1], return_counts=True))


class _Document:
    """What alignment has found of one text so far."""

    __slots__ = ("n_a", "n_b", "n_groups", "broken", "codes", "times", "text", "sha", "blank")

    def __init__(self, whole: bool):
        self.n_a = self.n_b = self.n_groups = 0
        self.broken = False
        self.blank = True
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text: list[bytes] | None = [] if whole else None
        self.sha = hashlib.sha256()

    def write(self, groups: bytes) -> None:
        part = groups[1:] if self.blank else groups  # the first group has no mark before it
        self.blank = False
        self.sha.update(part)
        if self.text is not None:
            self.text.append(part)

    def add_pairs(self, codes: np.ndarray, times: np.ndarray) -> None:
        if len(self.codes):
            both, inverse = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            self.times = np.bincount(inverse, np.concatenate([self.times, times]), len(both)).astype(np.int64)
            self.codes = both
        else:
            self.codes, self.times = codes, times

    def row(self) -> tuple:
        if self.broken or self.blank:
            return 0, 0, 0, 0, "", "" if self.text is not None else None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        groups = b"".join(self.text).decode() if self.text is not None else None
        return self.n_a, self.n_b, self.n_groups, int(self.times.sum()), self.sha.hexdigest(), groups, self.codes, self.times


_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
_BLOCK_ROW = f"block long, row long, doc_id long, {_COLUMNS}, places binary, times binary, codes array<long>, docs array<long>"
_ARROW = pa.schema(
    [
        *[pa.field(c, pa.int64()) for c in ("block", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links")],
        *[pa.field(c, pa.string()) for c in ("groups_sha256", "groups")],
        *[pa.field(c, pa.binary()) for c in ("places", "times")],
        *[pa.field(c, pa.list_(pa.int64())) for c in ("codes", "docs")],
    ]
)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool, block_pairs: int) -> DataFrame:
    """Rows of documents, with the places and multiplicities of their pairs in the
    dictionary of their block, and rows of dictionaries (codes, documents of the block)."""

    def flush(block: int, ready: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = [r[-2] for r in ready]
        codes, inverse = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.bincount(inverse, minlength=len(codes))
        no_row = (None,) * (len(_ARROW) - 3)
        rows: list[tuple] = []
        at = 0
        for k, (doc_id, *head, own, times) in enumerate(ready):
            places = inverse[at : at + len(own)].astype("<u4").tobytes()
            at += len(own)
            rows.append((block, k, doc_id, *head, places, times.astype("<u4").tobytes(), None, None))
        for i in range(0, len(codes), CHUNK):
            rows.append((block, *no_row, codes[i : i + CHUNK], counts[i : i + CHUNK]))
        for i in range(0, len(rows), 256):
            part = list(zip(*rows[i : i + 256], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        open_docs: dict[int, _Document] = {}
        ids: dict[int, int | None] = {}
        owners: list[int] = []
        pieces: list[str] = []
        chars = pairs = number = 0
        ready: list[tuple] = []

        def work() -> None:
            nonlocal chars
            if pieces:
                aligner.align(owners, pieces, open_docs)
            owners.clear()
            pieces.clear()
            chars = 0

        def close() -> None:
            nonlocal pairs
            for k in list(open_docs):
                row = open_docs.pop(k).row()
                pairs += len(row[-1])
                ready.append((ids.pop(k), *row))

        for batch in batches:
            for doc_id, scalar in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = scalar.as_py()
                number += 1
                open_docs[number] = _Document(keep_groups)
                ids[number] = doc_id
                for piece in text_pieces(text) if text else []:
                    owners.append(number)
                    pieces.append(piece)
                    chars += len(piece)
                    if chars >= BATCH_CHARS:
                        work()
                if not pieces or chars >= BATCH_CHARS // 2 or len(open_docs) >= 2048:
                    work()
                    close()
                    if pairs >= block_pairs:
                        yield from flush(block, ready)
                        ready, pairs, block = [], 0, block + 1
        work()
        close()
        if ready:
            yield from flush(block, ready)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCK_ROW)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """code and n (documents that hold the pair linked), from the dictionaries of all
    blocks. The code of a pair is A's id times B's vocabulary size, plus B's id."""
    entries = blocks.where("codes IS NOT NULL").select(F.explode(F.arrays_zip("codes", "docs")).alias("e"))
    return entries.groupBy(F.col("e.codes").alias("code")).agg(F.sum("e.docs").alias("n"))


def align(
    docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True, block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, and groups (``a1,a2|b1;a3|b2,b3``; null unless ``keep_groups``).

    Rows are kept apart, whatever their doc_id (null or repeated). Texts that are null
    or empty, or that the vocabularies do not give back byte by byte, have no tokens:
    all numbers 0, groups and hash empty. Other columns of ``docs`` are ignored.
    """
    blocks = write_table(aligned_blocks(docs, a_path, b_path, keep_groups, block_pairs), "aligned")
    counts = write_table(pair_counts(blocks), "pairs")
    a_id = F.expr(f"code div {PieceTokenizer(b_path).size}")
    top = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a_id", a_id).join(top, "a_id").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    entries = blocks.where("codes IS NOT NULL").select("block", F.explode("codes").alias("code")).join(judged, "code")
    row = F.struct("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "places", "times")
    dictionary = entries.select("block", "code", "n", "best", F.lit(None).cast(blocks.select(row.alias("r")).schema["r"].dataType).alias("r"))
    rows = blocks.where("codes IS NULL").select(
        "block", F.lit(None).cast("long").alias("code"), F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("boolean").alias("best"), row.alias("r"),
    )
    together = dictionary.unionAll(rows).repartition("block").sortWithinPartitions("block", F.col("code").asc_nulls_last())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        numbers: list[np.ndarray] = []
        bests: list[np.ndarray] = []
        n = best = None
        for batch in batches:
            owners = batch.column("block").to_numpy()
            is_row = np.asarray(batch.column("code").is_null())
            edges = np.flatnonzero((owners[1:] != owners[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if s == e:
                    continue
                if owners[s] != block:
                    block, numbers, bests, n = owners[s], [], [], None
                part = batch.slice(s, e - s)
                if not is_row[s]:
                    numbers.append(part.column("n").to_numpy())
                    bests.append(part.column("best").to_numpy(zero_copy_only=False))
                    continue
                if n is None:
                    n = np.concatenate([*numbers, np.zeros(0, np.int64)])
                    best = np.concatenate([*bests, np.zeros(0, bool)]).astype(np.int64)
                fields = part.column("r").flatten()
                names = [f.name for f in part.schema.field("r").type]
                got = dict(zip(names, fields, strict=True))
                count_sum, n_best = [], []
                for places, times in zip(got["places"], got["times"], strict=True):
                    at = np.frombuffer(places.as_buffer(), "<u4")
                    k = np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
                    count_sum.append(int(n[at] @ k))
                    n_best.append(int(best[at] @ k))
                yield pa.RecordBatch.from_arrays(
                    [got[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                    + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), got["groups_sha256"], got["groups"]],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"],
                )

    return together.mapInArrow(
        score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    )
