"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm.chat import chat_windows, digests, read_back
from lagoon.llm.common import table
from lagoon.llm.decontaminate import benchmark_overlaps
from lagoon.llm.html_text import extract_main_text
from lagoon.llm.licenses import license_scan
from lagoon.llm.packing import pack
from lagoon.llm.simhash import near_duplicates
from lagoon.llm.token_counts import token_counts
from lagoon.llm.topk import top_k
from lagoon.llm.toxicity import toxicity
from lagoon.llm.url_filter import EXPLICIT, default_patterns, judge_urls


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document by the byte-level vocabulary of 50,000; over_limit beyond 1,024 tokens."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of a document that repeats a passage of the benchmark within a tenth of its characters."""
    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, at most 3 bits apart."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; the lexicon is learned from labelled rows outside the held-out third."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted phrases and license labels of every document."""
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed into sequences of 4,096 tokens."""
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by the explicit rules, else by the default patterns."""
    return judge_urls(table(spark, sf_dir, "pages"), EXPLICIT + default_patterns())


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one that says control strings, read back from its formatted windows."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(read_back(chat_windows(turns)))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products for each vector whose id is divisible by 50, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_html_text": op2_html_text,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_chat_format": op9_chat_format,
    "op10_top_k": op10_top_k,
}

#: Each rule's action, host and path as the query states them, against every URL.
_RULES = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in EXPLICIT)
_PATTERNS = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in default_patterns())

ORACLES: dict[str, str] = {
    "op8_url_filter": rf"""
        WITH parts AS (
            SELECT row_number() OVER () AS n, page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        rules(action, rhost, rpath) AS (VALUES {_RULES}),
        fits AS (
            SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
            FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY n),
        shapes(paction, phost, ppath) AS (VALUES {_PATTERNS}),
        regexes AS (
            SELECT paction, phost || ppath AS pattern,
                   CASE WHEN phost = '' THEN '' ELSE '^(?:.*\.)?' || replace(regexp_escape(phost), '\*', '.*') || '$' END AS hosts,
                   '^' || replace(replace(regexp_replace(regexp_escape(ppath), '\\\|$', '$'), '\*', '.*'), '\^', '(?:[^A-Za-z0-9.-]|$)') AS paths
            FROM shapes),
        patterns AS (
            SELECT n, arg_max(pattern, (length(pattern), pattern)) AS pattern, arg_max(paction, (length(pattern), pattern)) AS paction
            FROM parts JOIN regexes ON regexp_matches(host, hosts, 's') AND regexp_matches(path, paths, 's')
            GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(action, paction, 'allow') AS verdict,
               CASE WHEN rule IS NULL THEN pattern END AS pattern
        FROM parts LEFT JOIN fits USING (n) LEFT JOIN patterns USING (n)""",
    "op9_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   len(regexp_extract_all(coalesce(role, '') || ' ' || coalesce(text, ''), '[a-zA-Z_0-9]+|[^a-zA-Z_0-9\s]')) + 4 AS tokens,
                   CAST(floor(turn / 256.0) AS BIGINT) AS chunk
            FROM said),
        ordered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn, role, text) AS nth, min(chunk) OVER (PARTITION BY conv_id) AS first_chunk,
                   length(role) + length(text) + 23
                   + len(regexp_extract_all(role, '[<\[]\\*(?:\||/?s>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\])')) AS size
            FROM t),
        opening AS (SELECT conv_id, tokens AS held, size AS again FROM ordered WHERE chunk = first_chunk AND nth = 1 AND role = 'system' AND tokens <= 576),
        costed AS (
            SELECT o.*, held IS NOT NULL AND chunk = first_chunk AND nth = 1 AS opens, (768 - coalesce(held, 0)) // 2 AS stride,
                   CASE WHEN opens THEN 0 ELSE tokens END AS cost
            FROM ordered o LEFT JOIN opening USING (conv_id)),
        summed AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id, chunk ORDER BY nth) - cost AS pos FROM costed),
        placed AS (
            SELECT *, min(pos) OVER w AS wbegin, max(pos + cost) OVER w AS wend
            FROM summed WINDOW w AS (PARTITION BY conv_id, chunk, pos // stride, cost > stride)),
        filled AS (SELECT conv_id, chunk, wbegin, bool_or(opens) AS opens FROM placed GROUP BY ALL),
        extra AS (
            SELECT p.conv_id, p.size + 1 AS size FROM placed p JOIN filled f ON f.conv_id = p.conv_id AND f.chunk = p.chunk AND f.wbegin = p.wend
            WHERE NOT p.opens AND p.wend - p.pos <= 256
            UNION ALL SELECT conv_id, again + 1 FROM filled JOIN opening USING (conv_id) WHERE NOT opens),
        chars AS (SELECT conv_id, sum(size) AS formatted_chars FROM (SELECT conv_id, size FROM placed UNION ALL SELECT * FROM extra) GROUP BY conv_id)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(any_value(formatted_chars) AS BIGINT) AS formatted_chars
        FROM t JOIN chars USING (conv_id) GROUP BY conv_id""",
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
