"""The operators of this subpackage as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import near_duplicate_vectors
from .erasure import erase
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .mixing import mix
from .packing import pack_documents
from .personal_data import find_personal_data
from .secrets import scan_secrets
from .sharding import shard_documents
from .token_counts import count_tokens
from .toxicity import toxicity
from .url_filters import Rule, judge_urls
from .vector_codes import compress

#: The rule table of op2.
URL_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erase(*(_table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")), share=350, every=400)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filters": op2_url_filters,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_secret_scans": op4_secret_scans,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_erasure": op12_erasure,
    "op13_personal_data": op13_personal_data,
}

def _vector_codes_sql(rounds: int) -> str:
    """Full search of every entry in every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
            SELECT vec_id, p, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d
            FROM (SELECT vec_id, p, entry, list_sum(list_transform(range(1, len(c) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM cut JOIN book{r} USING (p))
            GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""mean{r} AS MATERIALIZED (
            SELECT p, entry, list(c ORDER BY i) AS c
            FROM (SELECT p, entry, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM (SELECT p, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{r} JOIN cut USING (vec_id, p)) GROUP BY p, entry, i)
            GROUP BY p, entry),
        book{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.entry = m.entry)""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS v FROM (SELECT vec_id, v, unnest(range(8)) AS p FROM kept)),
        seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16),
        book0 AS MATERIALIZED (SELECT p, entry, v AS c FROM cut JOIN seeds USING (vec_id)),
        {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _vector_codes_sql(6),
    "op2_url_filters": r"""
        WITH rules(rule, host, path, verdict) AS (VALUES
            ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
            ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
            ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        parts AS (
            SELECT page_id, row_number() OVER () AS r,
                translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path,
                regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS query
            FROM pages),
        best AS (
            SELECT p.r, arg_max(u.rule, length(u.rule)) AS rule, arg_max(u.verdict, length(u.rule)) AS verdict
            FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)
            GROUP BY p.r)
        SELECT page_id, host, path, rule,
            coalesce(best.verdict, CASE
                WHEN regexp_matches(host, '(?i)(^|[^a-z0-9])(bets|betting|casino|cheap|loans|lottery|pills|poker|porn|slots|viagra|warez|xxx)([^a-z0-9]|$)') THEN 'block'
                WHEN regexp_matches(host, '(?is)adserver.*\.') THEN 'block'
                WHEN regexp_matches(path || query, '(?is)^/((wp-login|xmlrpc)\.php([^a-z0-9]|$)|cgi-bin/|.*/(cart|checkout)([^a-z0-9]|$)|.*\.exe$|.*[^a-z0-9]sessionid([^a-z0-9]|$)|.*/print/.*\?)')
                    THEN 'block'
                ELSE 'allow' END) AS verdict
        FROM parts LEFT JOIN best USING (r)""",
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
        flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        link AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT doc_id, len(s) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN many ON vec_id = many.a""",
    "op7_exact_dedup": """
        WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM documents JOIN g ON coalesce(text, '') = t""",
}
