"""The registered queries of this subpackage: thin wrappers with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_rules import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc_store import archive_pages, measure_records

    return measure_records(archive_pages(_table(spark, sf_dir, "pages")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_scan import scan_documents

    return scan_documents(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import score_toxicity, train_on

    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_on(docs, _table(spark, sf_dir, "labels")))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vector_dedup import link_vectors

    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import judge, train_on

    docs = _table(spark, sf_dir, "documents")
    return judge(docs, train_on(docs, _table(spark, sf_dir, "labels")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash import near_copies

    return near_copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_language": op8_language,
    "op9_secret_scan": op9_secret_scan,
    "op10_minhash": op10_minhash,
}

_KINDS = (
    # kind, pattern, group to test, code points it must have; the first three are the base
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)


def _secrets_sql() -> str:
    """A match's start is the length of all text before it: of the gaps and of the earlier matches."""
    parts = []
    for number, (kind, pattern, group, least) in enumerate(_KINDS):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"SELECT row, {number} AS number, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, length(hits[i]) AS n FROM "
            f"(SELECT row, hits, gaps, tested, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT row, regexp_extract_all(t, '{quoted}') AS hits, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}', {group}) AS tested FROM d)) WHERE length(tested[i]) >= {least}"
        )
    line = "kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT row, string_agg({line}, ',' ORDER BY a, number) AS spans, string_agg({line}, ',' ORDER BY a, number) FILTER (number < 3) AS base, {", ".join(f"count(*) FILTER (number = {i}) AS n_{k[0]}" for i, k in enumerate(_KINDS[:3]))} FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)"""


ORACLES: dict[str, str] = {
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS size, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS holder FROM p)
SELECT page_id, size AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN holder <> page_id THEN holder END AS refers_to FROM q""",
    "op5_vector_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.n WHERE r.root < l.b),
c AS (SELECT n, min(root) AS root FROM r GROUP BY n), k AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, root AS component_id, root = vec_id AS kept FROM v JOIN c ON c.n = v.vec_id LEFT JOIN k ON k.a = v.vec_id""",
    "op9_secret_scan": _secrets_sql(),
}
