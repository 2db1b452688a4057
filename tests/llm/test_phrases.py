"""Phrase mining against brute force counts."""

import collections
import random
import re

import numpy as np
import pytest

from salescope.llm import phrases as ph

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SMALL = {"entries": 60, "container": 3, "vocabulary": 25, "slice": 64, "hot": 1, "parts": 5}


def expected(rows, top=2000, least=30, longest=4, percent=80):
    f = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = collections.Counter()
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        found = []
        for g, a in candidates.items():
            if 100 * inside[g] >= percent * a:
                continue
            score, _, left, right = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "\x00", "a\x01b", "ß" * 3, "ÄB", *(f"w{i}" for i in range(12))]
    glue = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\x0c", "\r\n", "!?", "\xa0", "\x1c"]
    out = []
    for _ in range(n):
        hot = rng.random() < 0.4
        out.append("".join(("the" if hot and rng.random() < 0.5 else rng.choice(words)) + rng.choice(glue) for _ in range(rng.randrange(60))))
    return out


@pytest.fixture(scope="module")
def rows():
    langs = ["en", "de", None, "und", ""]
    some = [(langs[i % 5], t) for i, t in enumerate(texts(150, 5))]
    return [*some, *some[:20], ("en", None), ("en", ""), (None, " \t "), ("xx", "the of " * 4000), ("yy", "x" * 9000), ("yy", "same phrase here. " * 40)]


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limits", [None, SMALL])
def test_matches_brute_force(spark, rows, limits):
    docs = spark.createDataFrame(
        [(i % 3, lang, t, "x", 1, "k", "f", 2) for i, (lang, t) in enumerate(rows)],
        "doc_id long, lang string, text string, phrase string, n long, words string, f string, rank int",
    ).repartition(3)
    assert found(ph.collocations(docs, limits=limits)) == expected(rows)


def test_other_parameters(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = found(ph.collocations(docs, top=7, least=3, longest=5, inside_percent=50, limits=SMALL))
    assert got == expected(rows, 7, 3, 5, 50)
    assert found(ph.collocations(docs, longest=2, least=5)) == expected(rows, 2000, 5, 2)


def test_empty_table(spark):
    assert found(ph.collocations(spark.createDataFrame([], "lang string, text string"))) == []


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", "p", 9 * 10**18, ["p"]), ("en", "q", 8 * 10**18, ["q"]), ("en", "p q", 7 * 10**18, ["p", "q"])],
        "lang string, phrase string, f long, words array<string>",
    )
    assert ph.scored(counts, 30).first()["score"] == 2000000 * 7 // 17


def test_word_ids_look_up_few_strings(monkeypatch):
    """Ids equal those of the split text, also where words share slots; words that are
    known already are not made strings again."""
    monkeypatch.setattr(ph, "TOGETHER", 256, raising=False)
    monkeypatch.setattr(ph, "SLOT_BITS", 8, raising=False)
    rng = random.Random(4)
    alphabet = [b"a", b"b", b"\x00", b"\xc3\xa9", b"\x1c"]
    words = [b"".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 2, 6, 7, 8, 9, 14, 15, 16, 40) for _ in range(4)]
    words += [b"a", b"a\x00", b"a" * 8, b"a" * 8 + b"\x00", b"a" * 15, b"a" * 16, b"a" * 15 + b"\x00"]

    class Counted(ph.Vocabulary):
        looked_up = 0

        def __getitem__(self, word):
            self.looked_up += 1
            return super().__getitem__(word)

    vocabulary = Counted()
    for data in (b"", b" ", b"\n", b"a", b"  a\n\nb ", b" ".join(rng.choice(words) + rng.choice([b"", b"\n", b"  "]) for _ in range(5000))):
        want = [w for w in data.replace(b"\n", b" \n ").split(b" ") if w]
        assert [vocabulary.words[i] for i in ph.word_ids(data, vocabulary).tolist()] == want
    assert sorted(set(vocabulary.words)) == sorted(vocabulary.words)
    monkeypatch.setattr(ph, "SLOT_BITS", 16)
    vocabulary = Counted()
    assert len(ph.word_ids(b"some words that come again " * 5000, vocabulary)) == 25000
    assert vocabulary.looked_up <= 256


@pytest.mark.parametrize("steps", [[1 << 32], [0, 3, 5, 5, 1 << 32]])
def test_merge_sums_phrases_of_equal_hashes(steps):
    """Different phrases of one hash stay apart; every phrase with enough occurrences is found once."""
    rng = random.Random(6)
    merge, want = ph.Merge(10), collections.Counter()
    for _ in range(30):
        entries = sorted((k % 8, f"p {k}") for k in rng.choices(range(60), k=20))
        counts = [rng.randrange(1, 4) for _ in entries]
        for (_, p), n in zip(entries, counts, strict=True):
            want[p] += n
        hashes = np.array([h for h, _ in entries], np.uint32)
        merge.add(hashes.tobytes(), "\n".join(p for _, p in entries).encode(), np.array(counts, np.int64).tobytes())
    got = [row for below in steps for row in merge.take(below)]
    assert sorted(got) == sorted((p, n) for p, n in want.items() if n >= 10) and merge.size == 0


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    trie, want = ph.HatTrie(container=4), collections.Counter()
    for n in (2, 3, 4, 3, 4):
        columns = list(rng.integers(1, 6, (n, 200)))
        trie.add(f"{n == 2}", columns)
        want.update(tuple(map(int, x)) for x in zip(*columns, strict=True))
    assert any(isinstance(box, dict) and not isinstance(box, collections.Counter) for box in trie.roots["False"].values())
    assert trie.entries == len(want) == sum(n for n, _, _ in trie.sizes())
    largest = max(trie.sizes())
    got = collections.Counter()
    for k, keep in enumerate((len(want) - 1, 0)):
        for _, columns, counts in ph._spilled(trie, keep):
            got.update(dict(zip(map(tuple, np.array(columns).T.tolist()), counts.tolist(), strict=True)))
        if k == 0:  # one whole subtree, the largest
            assert len(got) == largest[0] and {g[0] for g in got} == {largest[2]}
    assert got == want and trie.entries == 0


def test_filter_keeps_every_entry(spark):
    rng = random.Random(2)
    entries = {("en", f"{rng.random()} {rng.random()}") for _ in range(500)}
    known = ph.frequent_filter(spark.createDataFrame(list(entries), "lang string, phrase string"))
    hashes = [np.array([ph.word_hash(p.encode().split(b" ")[k]) for _, p in entries], np.uint64) for k in (0, 1)]
    assert known.passes(ph.phrase_hashes(hashes, "en")).all()
    assert known.passes(ph.phrase_hashes(hashes, "de")).mean() < 0.1
