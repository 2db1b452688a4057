"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, graph, langid, minhash, mixing, packing, phrases, secrets, sitetree, topk, toxicity, urlfilter, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def alignment_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_takes(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = alignment_paths()
    return align.align(_table(spark, sf_dir, "documents"), a, b, keep_groups=False).drop("groups")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_minhash_dedup,
        op3_url_filter,
        op4_html_extraction,
        op5_mixing,
        op6_packing,
        op7_embedding_dedup,
        op8_toxicity,
        op9_top_k,
        op10_warc,
        op11_tokenizer_alignment,
        op12_language_id,
        op13_phrase_mining,
    )
}

#: DuckDB SQL where it can express a query.
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": """
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN contains(url, '://')
                        THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                        ELSE '' END AS host,
                   CASE WHEN contains(url, '://')
                        THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
            FROM pages
        ), listed(verdict, h, p) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), best AS (
            SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
            FROM parts JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN best USING (page_id)""",
    "op5_mixing": """
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), weighted AS (
            SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                      WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                   2.0::DOUBLE * source_size AS cap
            FROM sources
        ), filled AS (
            -- the level at which the sources hold 1.5 times all words; a source is full at cap / w
            SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5::DOUBLE
                       - coalesce((SELECT sum(b.cap) FROM weighted b WHERE b.cap / b.w < a.cap / a.w), 0))
                      / (SELECT sum(b.w) FROM weighted b WHERE b.cap / b.w >= a.cap / a.w) AS level
            FROM weighted a
        ), targets AS (
            SELECT source, source_size,
                   least(cap, w * coalesce((SELECT max(level) FROM filled WHERE level <= cap / w), 1e300)) AS target
            FROM filled
        ), placed AS (
            SELECT doc_id, size, source_size, target,
                   floor(target + 0.5)::BIGINT AS budget,
                   coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
                + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size
                                          - prefix)))::BIGINT AS taken
        FROM placed""",
    "op9_top_k": """
        WITH ints AS (
            SELECT vec_id, row_number() OVER () AS nr, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.nr, q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
            FROM ints q JOIN ints r ON q.nr <> r.nr AND q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, (row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op10_warc": """
        WITH hashed AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), first AS (
            SELECT payload_digest, min(page_id) AS page_id FROM hashed WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT h.page_id, payload_bytes, h.payload_digest,
               CASE WHEN f.page_id IS NULL OR f.page_id = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.page_id <> h.page_id THEN f.page_id END AS refers_to
        FROM hashed h LEFT JOIN first f USING (payload_digest)""",
    "op13_phrase_mining": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), runs AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
        ), starts AS (
            SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs, (VALUES (1), (2), (3), (4)) sizes(k)
        ), f AS (
            SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f FROM starts GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
        ), often AS (
            SELECT * FROM f WHERE f >= 30
        ), cuts AS (
            SELECT c.lang, c.k, c.g, c.f AS a, c.j, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.f) // (h.f + t.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM often WHERE k > 1) c
            JOIN often h ON h.lang = c.lang AND h.g = c.g[1:c.j]
            JOIN often t ON t.lang = c.lang AND t.g = c.g[c.j + 1:c.k]
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
        ), inner_parts AS (
            SELECT lang, f, g, k, m, unnest(range(1, k - m + 2)) AS i FROM often, (VALUES (2), (3)) parts(m) WHERE k > m
        ), longer AS (
            SELECT lang, g[i:i + m - 1] AS g, max(f) AS most FROM inner_parts GROUP BY ALL
        ), kept AS (
            SELECT x.* FROM lowest x LEFT JOIN longer y ON y.lang = x.lang AND y.g = x.g
            WHERE y.most IS NULL OR 100::HUGEINT * y.most < 80::HUGEINT * x.a
        ), ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
                   array_to_string(g, ' ') AS phrase, a, l, r, score
            FROM kept
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
