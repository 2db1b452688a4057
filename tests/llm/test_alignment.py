"""Cross-tokenizer alignment against a plain walk over both tokenizers' tokens."""

import collections
import hashlib
import random

import numpy as np
import pytest

from salescope.llm import align as al
from salescope.llm.queries import alignment_paths

ALPHABET = "ab'sé ß\n\t  .,1٣①中文🙂<|endoftext|>\x00\x1c　́"


@pytest.fixture(scope="module")
def tokenizers():
    a, b = alignment_paths()
    return al.ByteTokenizer(a), al.PieceTokenizer(b)


def spans(ids, pieces):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(pieces[i]), i))
        at += len(pieces[i])
    return out


def expected(rows, a, b):
    whole, pairs, docs = [], {}, collections.Counter()
    for k, (doc_id, text) in enumerate(rows):
        raw = (" " + (text or "")).encode()
        a_ids = a.model.encode(" " + (text or ""), add_special_tokens=False).ids
        b_ids = b.model.encode(text or "")
        if not text or b"".join(a.bytes[i] for i in a_ids) != raw or b"".join(b.bytes[i] for i in b_ids) != raw:
            whole.append((doc_id, 0, 0, 0, 0, ""))
            pairs[k] = []
            continue
        sa, sb = spans(a_ids, a.bytes), spans(b_ids, b.bytes)
        groups = []
        start = 0
        for cut in sorted({e for _, e, _ in sa} & {e for _, e, _ in sb}):
            inside = [",".join(str(i) for s, e, i in side if start <= s and e <= cut) for side in (sa, sb)]
            groups.append("|".join(inside))
            start = cut
        pairs[k] = [(i, j) for s, e, i in sa for t, f, j in sb if t < e and s < f]
        docs.update(set(pairs[k]))
        whole.append((doc_id, len(sa), len(sb), len(groups), len(pairs[k]), ";".join(groups)))
    top = collections.Counter()
    for (i, _), n in docs.items():
        top[i] = max(top[i], n)
    return sorted(
        (
            (*row[:5], sum(docs[p] == top[p[0]] for p in pairs[k]), sum(docs[p] for p in pairs[k]),
             hashlib.sha256(row[5].encode()).hexdigest() if row[5] else "", row[5])
            for k, row in enumerate(whole)
        ),
        key=repr,
    )


def noise(n, seed, longest=120):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, longest))) for _ in range(n)]


CASES = [None, "", " ", "a▁b", "▁", "x" * 700, " " * 300 + "a", "<|endoftext|> <s></s><unk><0x41>", "\n" * 200, "the same text", "the same text"]


def test_alignment_matches_plain_walk(spark, docs_of, tokenizers):
    texts = CASES + noise(60, 1)
    rows = [(None if i % 9 == 4 else i % 31, t) for i, t in enumerate(texts)]
    docs = docs_of([(i, t, "a") for i, t in rows]).withColumnsRenamed({"spans": "block", "size": "code", "root": "groups"})
    want = expected(rows, *tokenizers)
    for block_pairs in (al.BLOCK_PAIRS, 40):  # one block a task, and many
        got = al.align(docs.repartition(3), *alignment_paths(), block_pairs=block_pairs)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_query_leaves_groups_out(docs_of):
    got = al.align(docs_of([(1, "two words", "a")]), *alignment_paths(), keep_groups=False).first()
    assert got["groups"] is None and len(got["groups_sha256"]) == 64 and got["n_links"] == got["n_best"]


def test_empty_table(docs_of):
    assert al.align(docs_of([]), *alignment_paths()).collect() == []


def test_pieces_of_a_text_have_the_ids_of_the_whole(tokenizers):
    a, b = tokenizers
    for text in noise(150, 2, 400) + ["word  two   three \n four " * 40, "a ▁ b ▁▁ c" * 9]:
        pieces = al.text_pieces(text, 7)
        assert "".join(pieces) == " " + text
        assert sum(a.encode(pieces), []) == a.encode([" " + text])[0]
        assert sum(b.encode(pieces), []) == b.model.encode(text)


def test_fast_ids_are_the_tokenizers_ids(tokenizers, spark, sf_dir):
    a = tokenizers[0]
    assert a.fast is not None
    texts = [" " + r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    settled = [chr(c) for c in (0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0xA0, 0x250))]
    rng = random.Random(4)
    texts += ["".join(rng.choices(settled, k=300)) for _ in range(300)]
    texts += ["".join(rng.choices(" \n\t'’sreAé1½\xa0", k=200)) for _ in range(300)]
    texts += [" " * 130000, "a" * 130000, "<|endoftext|>" * 50, "\n" * 131000 + "x"]
    assert sum(bool(al._SETTLED.match(t)) for t in texts) > 400
    assert a.encode(texts) == [e.ids for e in a.model.encode_batch_fast(texts, add_special_tokens=False)]


def test_no_piece_of_the_vocabulary_goes_on_over_a_space(tokenizers):
    assert not [t for t in tokenizers[1].bytes if b" " in t.lstrip(b" ")]


def test_shared_cuts_are_all_common_ends():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (5, 900), (900, 5), (400, 400), (2000, 1999)):
        ends = []
        for k in (n, m):
            inner = np.sort(rng.choice(np.arange(1, 5000), k - 1, replace=False)) if k > 1 else np.zeros(0, int)
            ends.append(np.concatenate([inner, [5000]]))
        cut_a, cut_b = al.shared_cuts(*ends, np.array([n]), np.array([m]))
        common = np.intersect1d(*ends)
        assert (ends[0][cut_a - 1] == common).all() and (ends[1][cut_b - 1] == common).all()
