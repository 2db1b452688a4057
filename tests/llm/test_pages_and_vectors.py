"""Operators on pages and embeddings against brute force and round trips."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from oracle_compare import compare, duck
from salescope.llm import graph, queries, sitetree, topk, urlfilter, warc

PAGE = "page_id long, url string, html string, key string, digest string, host string"


@pytest.fixture(scope="module")
def pages_of(spark):
    return lambda rows: spark.createDataFrame([(i, u, h, "k", "d", "h") for i, u, h in rows], PAGE)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, sf_dir, name):
    assert not compare(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLE_SQL[name])


# ---- URL filter
URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?/fr/", "http://a.b.net/fr/1#x", "http://net/es/", "http://xnet/es/",
    "http://example.com/en", "http://example.com/en/", "https://www.example.com/en/", "https://sub.www.example.com/en/a",
    "http://com", "http://com/", "http://.com/", "http://a.com./", "ftp://x.org/a?b://c.com/", "http://host.net:80/fr/", "http://" + "a." * 3000 + "com/x",
]


def brute_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_judge_matches_brute_force(spark, pages_of, max_bytes):
    rng = random.Random(1)
    rules = list(urlfilter.RULES) + [("block", f"site{i}.org", "/") for i in range(0, 400, 2)]
    urls = URLS + [f"http://w{rng.randrange(3)}.site{rng.randrange(400)}.org/{rng.randrange(9)}" for _ in range(600)]
    out = urlfilter.judge(pages_of([(i, u, None) for i, u in enumerate(urls)]), urlfilter.rules_frame(spark, tuple(rules)), max_bytes=max_bytes)
    rows = out.collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_judge(urls[r["page_id"]], rules), urls[r["page_id"]][:80]


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    levels = urlfilter.build_cascade(universe, universe.where("cast(substr(key, 2) AS int) % 50 = 0"))
    assert len(levels) > 1
    rows = universe.selectExpr("xxhash64(key) AS h", "cast(substr(key, 2) AS int) % 50 = 0 AS listed").toPandas()
    told = urlfilter.member(levels, rows["h"].to_numpy().view(np.uint64))
    assert (told == rows["listed"].to_numpy()).all()


# ---- HTML extraction
def test_extraction_cases(pages_of):
    html = {
        1: None, 2: "", 3: "just  text &amp; more&nbsp;",
        4: "<body><nav>menu</nav><article><h1>A &lt;b&gt;</h1><p>one\n two<b> three<br><p>four</p><div class='comments'><p>rude</p></div></article><footer>f</footer>",
        5: "<div id=main><p>kept</div><div class=ad>buy</div><script>var a='<p>x</p>'</script><!-- <p>c</p> --><style>p{}</style><form>q</form>",
        6: "<p>" + "word " * 200_000 + "</p>", 7: "<p>unclosed <i>tag", 8: "a < b > c &am &copy; <x-tag>in</x-tag>line",
    }
    rows = {r["page_id"]: r for r in sitetree.extract(pages_of([(i, "http://h/", h) for i, h in html.items()])).collect()}
    want = {1: "", 2: "", 3: "just text & more", 4: "A <b>\none two three\nfour", 5: "kept", 7: "unclosed tag", 8: "a < b > c &am © inline"}
    for i, text in want.items():
        assert rows[i]["text"] == text and rows[i]["n_chars"] == len(text), i
    assert rows[6]["n_chars"] == 200_000 * 5 - 1


def test_site_tree_removes_what_a_host_repeats(pages_of):
    page = lambda i: f"<body><div class=z1><p>Home</p><p>About us</p></div><div class=z2><p>story {i} is told</p><p>more of {i}</p></div></body>"
    rows = [(i, "http://one.org/", page(i)) for i in range(30)] + [(100, "http://two.org/", page(100))]
    rows += [(200 + i, "http://same.org/", "<body><div class=a><p>always this</p></div></body>") for i in range(10)]
    out = {r["page_id"]: r["text"] for r in sitetree.extract(pages_of(rows)).collect()}
    assert out[3] == "story 3 is told\nmore of 3"
    assert out[100].startswith("Home\nAbout us")  # one page does not show what its host repeats
    assert out[205] == "always this"  # nothing else on the page


def test_blocks_that_a_host_repeats_go_from_the_article(pages_of):
    page = lambda i: f"<article><h1>title {i}</h1><p>Sign up <b>now</b></p><p>story {i}</p><p>shared</p>and {i}<p>Rate this page</article>"
    rows = [(i, "http://one.org/", page(i).replace("shared", "shared" if i < 10 else f"own {i}")) for i in range(20)]
    rows += [(100 + i, "http://copy.org/", page(0 if i < 9 else i)) for i in range(11)]  # three distinct pages
    rows += [(200, "http://one.org/2", "<article><p>Sign up <b>now</b></p></article>")]
    out = {r["page_id"]: r["text"] for r in sitetree.extract(pages_of(rows)).collect()}
    assert out[3] == "title 3\nstory 3\nshared\nand 3"  # on half of the pages, not on most
    assert out[15] == "title 15\nstory 15\nown 15\nand 15"
    assert out[100] == "title 0\nSign up now\nstory 0\nshared\nand 0\nRate this page"
    assert out[200] == "Sign up now"  # nothing else on the page


def test_copies_do_not_make_a_template(pages_of):
    page = lambda i, more="": f"<body><div class=c><p>story {i}</p></div>{more}</body>"
    rows = [(i, f"http://one.org/{i}", page(0)) for i in range(8)]
    rows += [(i, f"http://one.org/{i}", page(i, "<div class=x>extra</div>")) for i in (8, 9)]
    out = {r["page_id"]: r["text"] for r in sitetree.extract(pages_of(rows)).collect()}
    assert out[8] == "story 8\nextra" and out[9] == "story 9\nextra"
    assert out[0] == out[7] == "story 0"


# ---- WARC
def warc_rows():
    same = "<p>" + "x" * 200
    return [(5, "http://b.com/é", same), (3, None, same), (9, "http://a.com/", "tiny"), (8, "http://a.com/", "tiny"), (1, "http://a.com/\r\nx", None),
            (2, "", "é" * 50), (4, "http://c.com", "é" * 50), (6, "http://c.com", same), (6, "http://c.com", same)]


def test_round_trip(pages_of):
    out = sorted(tuple(r) for r in warc.round_trip(pages_of(warc_rows())).collect())
    want = []
    for i, _, h in warc_rows():
        raw = (h or "").encode()
        first = min(j for j, _, x in warc_rows() if x == h)
        revisit = len(raw) >= 100 and first != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert [r[:4] for r in out] == [w[:4] for w in sorted(want, key=lambda w: w[:4])]
    assert {(r[0], r[4]) for r in out} == {(w[0], w[4]) for w in want}


def test_lookup_by_url(pages_of, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i, f"http://h{i % 7}.org/{i}", f"<p>{i}" * 50) for i in range(100)] + [(200 + i, "http://h1.org/many", f"v{i}") for i in range(9)]
    folder = warc.scratch_path(pages_of(rows).sparkSession, "warc")
    directory = warc.write_index(warc.write_archives(warc.captures(pages_of(rows)), folder), folder, 4)
    assert directory.count() >= 25
    assert [(x["page_id"], x["payload"]) for x in warc.lookup(directory, folder, "http://h3.org/38")] == [(38, b"<p>38" * 50)]
    assert sorted(x["page_id"] for x in warc.lookup(directory, folder, "HTTP://H1.org/many")) == list(range(200, 209))
    assert warc.lookup(directory, folder, "http://nowhere.org/") == []


@pytest.mark.parametrize("characters", [256, 11])
def test_find_matches_a_scan_of_the_index(pages_of, monkeypatch, characters):
    """Keys that fill many blocks, agree in their first characters, or are missing."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "KEY_CHARACTERS", characters)
    rows = [(i, f"http://h{i % 7}.org/{'long' * 90}/{i % 30}", f"<p>{i}") for i in range(120)]
    rows += [(200 + i, "http://h1.org/hot", f"v{i}") for i in range(60)] + [(300, None, "n"), (301, "", None), (302, "x y\u00e9\n", "t")]
    pages = pages_of(rows)
    folder = warc.scratch_path(pages.sparkSession, "warc")
    directory = warc.write_index(warc.write_archives(warc.captures(pages), folder), folder, 4)
    assert len(warc.index_files(directory)) >= 4
    urls = [u for _, u, _ in rows[::3]] + ["http://h1.org/hot", None, "http://h1.org/ho", "http://zz.org/", "x y\u00e9\n"]
    asked = pages_of([(0, u, None) for u in urls])
    key = {r["key"] for r in asked.select(warc.url_key(asked["url"]).alias("key")).collect()}
    want = sorted(tuple(r) for r in warc.index_lines(directory, folder).collect() if r["key"] in key)
    got = sorted(tuple(r) for r in warc.find(asked, directory, folder).collect())
    assert got == want and len(got) >= 100
    read = {r["page_id"]: r for r in warc.read_records(warc.find(asked, directory, folder), folder).collect()}
    assert all(read[i]["url"] == u and read[i]["payload"] == (h or "").encode() for i, u, h in rows if i in read)
    assert {300, 301, 302} <= set(read)


def test_records_have_the_mandatory_fields():
    import datetime as dt
    import urllib.parse

    raw = warc.record_bytes(7, "http://a.com/x y\u00e9\r\nWARC-Type: fake", b"hi", hashlib.sha256(b"hi").hexdigest(), 2, None, "2024-01-02T03:04:05Z")
    head = raw.split(b"\r\n\r\n")[0].decode("ascii").split("\r\n")
    fields = dict(x.split(": ", 1) for x in head[1:])
    assert head[0] == "WARC/1.1" and fields["WARC-Type"] == "response"
    assert dt.datetime.fromisoformat(fields["WARC-Date"]).tzinfo is not None
    assert fields["WARC-Record-ID"].startswith("<urn:uuid:")
    assert urllib.parse.unquote(fields["WARC-Target-URI"]) == "http://a.com/x y\u00e9\r\nWARC-Type: fake"
    assert warc.parse_record(raw)["url"] == "http://a.com/x y\u00e9\r\nWARC-Type: fake"
    revisit = warc.record_bytes(8, None, None, "d" * 64, 200, 7, "2024-01-02T03:04:05Z")
    again = warc.parse_record(revisit)
    assert (again["url"], again["refers_to"], again["type"], again["payload"]) == (None, 7, "revisit", None)
    assert warc.record_id(7, "d" * 64).encode() in revisit


def test_very_long_payloads_and_urls(pages_of):
    long = "<p>" + "word " * 400_000
    rows = [(1, "http://a.com/" + "x" * 100_000, long), (2, "http://a.com/" + "x" * 100_001, long), (3, "http://a.com/", "tiny")]
    out = {r["page_id"]: r for r in warc.round_trip(pages_of(rows)).collect()}
    assert [(out[i]["payload_bytes"], out[i]["record_type"], out[i]["refers_to"]) for i in (1, 2, 3)] == [
        (len(long), "response", None), (len(long), "revisit", 1), (4, "response", None)]


# ---- vectors
VECTORS = "vec_id long, embedding array<float>, label int, links string, part int"


def vector_rows():
    rng = np.random.default_rng(4)
    rows = []
    centers = rng.normal(size=(12, 16))
    for i in range(900):
        c = centers[0] if i % 3 == 0 else centers[i % 12]
        v = c + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.5])
        rows.append((i + 1, [float(np.float32(x)) for x in v], int(i % 4 == 1)))
    rows += [(2000 + i, rows[0][1], 0) for i in range(30)] + [(2100, [x * 2 for x in rows[0][1]], 0), (2101, rows[0][1], None)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, [None] * 16, 0), (3004, [], 0),
             (3005, [float("inf")] * 16, 1), (3006, [1.0, 2.0], 0), (3007, [1.0, 2.0], 0), (3100, [1.0] * 16, 5)]
    return rows


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("nodes", [1024, 64])
def test_embedding_links_match_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(graph, "SHARD_NODES", nodes)
    monkeypatch.setattr(graph, "CLUSTER_ROWS", 100)
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], VECTORS)
    out = {r["vec_id"]: r for r in graph.near_duplicates(df).collect()}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if usable(v) and any(v) and lab is not None]
    links = {i: set() for i, _, _ in rows}
    for a, (i, x, la) in enumerate(good):
        for j, y, lb in good[:a]:
            if la == lb and len(x) == len(y) and x @ y >= 0.98 * np.sqrt((x @ x) * (y @ y)):
                links[i].add(j)
                links[j].add(i)
    total, found = sum(map(len, links.values())), sum(r["n_links"] for r in out.values())
    assert len(out) == len(rows) and all(out[i]["n_links"] <= len(links[i]) for i in links)
    assert found >= 0.97 * total
    for i, own in links.items():
        if not own:
            assert (out[i]["component_id"], out[i]["kept"]) == (i, True)
    assert graph.audit_recall(df.where("label = 0"), graph.near_duplicates(df), 100) >= 0.9


def test_top_k_matches_brute_force(spark):
    rows = [(i, v) for i, v, _ in vector_rows()] + [(4000, [1e30] * 16), (100, vector_rows()[3][1])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS)
    ints = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints.append((i, tuple(max(-(2**63), min(2**63 - 1, int(np.floor(1024 * float(np.float32(x)))))) for x in v)))
    want = []
    for at, (q, a) in enumerate(ints):
        if q % 100 == 0:
            scores = sorted(
                (-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for k, (i, b) in enumerate(ints) if k != at and len(b) == len(a)
            )
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    assert len({q for q, _ in ints}) < len(ints)
    for row_block in (200, 1 << 20):
        got = sorted(tuple(r) for r in topk.top_k(df, row_block=row_block).collect())
        assert got == sorted(want)


def test_top_k_of_repeated_ids_matches_sql(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(int(i) % 130, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(100, rows[100][1]), (1, rows[1][1]), (None, rows[2][1]), (200, None)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert not compare(topk.top_k(spark.read.parquet(path), row_block=64), con, queries.ORACLE_SQL["op9_top_k"])


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(5, 64)), rng.normal(size=(40, 64))
    for s in topk.LEVELS:
        (qm, qs), (xm, xs) = topk.segment_features(q, s), topk.segment_features(x, s)
        assert (qm @ xm.T + qs @ xs.T >= q @ x.T - 1e-9).all()


def test_empty_tables(spark, pages_of):
    pages, vectors = pages_of([]), spark.createDataFrame([], VECTORS)
    for df in (urlfilter.judge(pages, urlfilter.rules_frame(spark)), sitetree.extract(pages), warc.round_trip(pages),
               graph.near_duplicates(vectors), topk.top_k(vectors)):
        assert df.count() == 0
