"""Queries of text, search, event, ingest, model and window-by-time operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.functions import exprs as X
from lagoon.operators import events as E
from lagoon.operators import ingest as I
from lagoon.operators import models as M
from lagoon.operators import search as Q
from lagoon.operators import text as T
from lagoon.plans.registry import query
from lagoon.plans.tables import RETURNS, returns, table
from lagoon.sources.documents import extract_articles, extract_filings


def _dir(spark: SparkSession) -> None:
    """Iterative operators checkpoint, in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    import os
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))


@query(
    "f_string_functions",
    r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS domain, sha256(array_to_string(regexp_extract_all(lower(url), '[\p{L}\p{N}]+'), ' ')) AS digest,
      trim(regexp_replace(regexp_replace(regexp_replace(lower(url), 'https?://\S+', '', 'g'), '\p{Nd}+', '#', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS para, CASE WHEN regexp_matches(lower(url), 'feed|rss') THEN 'feed' WHEN regexp_matches(lower(url), 'page=') THEN 'paged' ELSE 'other' END AS category FROM pages""",
)
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.domain("url").alias("domain"), T.content_hash("url").alias("digest"), T.paragraph_key("url").alias("para"), T.first_category("url", {"feed": ["feed", "rss"], "paged": ["page="]}).alias("category"))


@query(
    "f_casts_dates",
    """SELECT event_id, TRY_CAST(props->>'k' AS DOUBLE) AS k, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS dow, ts::DATE = date_trunc('month', ts)::DATE AS month_start, hour(ts) + minute(ts) / 60.0 >= 16 AS after_close, round(hour(ts) + minute(ts) / 60.0, 6) AS hour, CASE WHEN event_type IN ('purchase', 'signup') THEN TRUE WHEN event_type IN ('error') THEN FALSE END AS flag FROM events""",
)
def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.hour("ts") + F.minute("ts") / 60.0
    word = F.when(F.col("event_type").isin("purchase", "signup"), "yes").when(F.col("event_type") == "error", "no").otherwise("?")
    return e.select("event_id", X.optional_number(F.get_json_object("props", "$.k")).alias("k"), F.to_date("ts").cast("string").alias("day"), F.weekday("ts").alias("dow"), (F.to_date("ts") == F.trunc("ts", "month")).alias("month_start"), (hour >= 16).alias("after_close"), F.round(hour, 6).alias("hour"), X.optional_bool(word).alias("flag"))


@query(
    "f_vectors",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v)
    SELECT vec_id, round(n, 6) AS norm, round(list_sum(list_transform(e, lambda x: x / n)), 5) AS total FROM n""",
)
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("u", X.unit("embedding"))
    return e.select("vec_id", F.round(F.sqrt(X.dot("embedding", "embedding")), 6).alias("norm"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    "x16_exact_dedup",
    r"""WITH h AS (SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ')) AS h FROM documents), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS m FROM h) SELECT doc_id, CASE WHEN m < doc_id THEN m END AS canonical FROM m""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exact_parents(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", T.content_hash("text")).select("doc_id", "canonical")


@query("x16_clean_dedup_corpus")
def clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _dir(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "text")
    d = T.clean_articles(d.join(T.learned_boilerplate(d, "doc_id", "source", "text"), "source", "left"), "text", boilerplate="boilerplate", title="title")
    d = d.select("doc_id", "source", "clean_words", "quality_status", T.words("cleaned").alias("w")).select("*", F.sha2(F.array_join("w", " "), 256).alias("h")).checkpoint()
    d = d.join(T.simhashes(d, "doc_id", T.word_shingles("w"), "fp"), "doc_id").drop("w").checkpoint()
    usable = F.col("quality_status") == "usable"
    roots = T.canonical_roots(d, "doc_id", F.col("h"), "fp", "clean_words", usable & (F.col("clean_words") >= 100), candidate=usable)
    return roots.join(T.reject_repeated_pages(d, "source", "h"), "doc_id").select("doc_id", "parent", "root", "quality_status", "clean_words")


@query("j21_text_pairs")
def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of fingerprint classes by the whole text (doc_id, lower), and of every other member the
    class's least doc_id (doc_id, representative)."""
    from lagoon.operators.joins import band_classes, band_pairs

    _dir(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", T.words("text").alias("w"))
    d = d.drop("w").join(T.simhashes(d, "doc_id", T.word_shingles("w"), "f"), "doc_id").checkpoint()
    pairs = band_pairs(d, "doc_id", "f", "n_chars").select("doc_id", "lower", F.lit(None).cast("bigint").alias("representative"))
    members = band_classes(d, "doc_id", "f", "n_chars").where("representative < doc_id").select("doc_id", F.lit(None).cast("bigint").alias("lower"), "representative")
    return pairs.unionByName(members)


@query("x18_chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text", delimiter="\n").select("doc_id", "chunk_index", "tokens", "first_paragraph", "last_paragraph", F.sha2("chunk", 256).alias("chunk_hash"))


@query(
    "x26_budgeted_text",
    """WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations)
    SELECT conv_id, string_agg(left(text, CAST(greatest(0, 600 - b) AS BIGINT)), '' ORDER BY turn) || CASE WHEN sum(length(text)) > 600 THEN ' [truncated]' ELSE '' END AS text FROM b GROUP BY 1""",
)
def budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.budgeted_concat(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", 600)


@query(
    "t10_t11_vector_search",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 7), s AS (SELECT vec_id, label, list_dot_product(v.e, q.e) AS s FROM v, q WHERE vec_id > 7 ORDER BY s DESC, vec_id LIMIT 40), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM s)
    SELECT label, arg_min(vec_id, rank) AS vec_id, CAST(min(rank) AS INTEGER) AS rank FROM r GROUP BY 1 ORDER BY rank LIMIT 5""",
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 7").first()["embedding"]
    hits = Q.vector_top_k(e, "vec_id", "embedding", q, 40, F.col("vec_id") > 7)
    return Q.first_per_article(hits.join(e.select("vec_id", "label"), "vec_id"), "vec_id", "label", 5)


BM25_SQL = r"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS l FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(l) AS m FROM l),
    h AS (SELECT p.doc_id, p.term, tf, l, n, m, count(*) OVER (PARTITION BY p.term) AS df FROM p JOIN l USING (doc_id), st WHERE term IN ('the', 'license')),
    b AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) AS score FROM h GROUP BY 1 HAVING count(*) = 2)"""


@query("x21_bm25", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Q.postings(table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0})
    return Q.bm25(index, "doc_id", ["the", "license"], 20).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "x22_hybrid_rrf",
    """WITH a AS (SELECT vec_id AS k, row_number() OVER (ORDER BY list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 7)) DESC, vec_id) AS r FROM embeddings), b AS (SELECT vec_id AS k, row_number() OVER (ORDER BY list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 11)) DESC, vec_id) AS r FROM embeddings),
    f AS (SELECT coalesce(a.k, b.k) AS k, a.r AS ar, b.r AS br FROM (SELECT * FROM a WHERE r <= 30) a FULL JOIN (SELECT * FROM b WHERE r <= 30) b ON a.k = b.k)
    SELECT k AS vec_id, round((coalesce(1.0 / (60 + ar), 0) + coalesce(1.0 / (60 + br), 0)) / (2.0 / 61), 6) AS score, CASE WHEN coalesce(ar, 1000000) <= coalesce(br, 1000000) THEN 'left' ELSE 'right' END AS branch FROM f ORDER BY (coalesce(1.0 / (60 + ar), 0) + coalesce(1.0 / (60 + br), 0)) / (2.0 / 61) DESC, k LIMIT 10""",
)
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = {r["vec_id"]: r["embedding"] for r in e.where("vec_id in (7, 11)").collect()}
    a, b = (Q.ranked(Q.vector_top_k(e, "vec_id", "embedding", q[k], 30), "vec_id") for k in (7, 11))
    return Q.fuse(a, b, "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"), "branch")


@query(
    "x20_clusters",
    """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.3),
    c(k, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, c.r FROM c JOIN p ON p.a = c.k), m AS (SELECT k, min(r) AS root FROM c GROUP BY 1)
    SELECT label, left(sha256(label || '|' || string_agg(k::VARCHAR, ',' ORDER BY k)), 24) AS cluster_id, min(k) AS representative, CAST(count(*) AS BIGINT) AS size FROM m JOIN v ON vec_id = k GROUP BY root, label""",
)
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _dir(spark)
    e = table(spark, sf_dir, "embeddings").withColumn("title", F.lit("t"))
    return E.cluster(e, "vec_id", "label", "embedding", "title", 0.3)[1].select("label", "cluster_id", "representative", "size")


@query(
    "i1_upsert_latest",
    """SELECT user_id, event_type, max(ts) AS ts, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1, 2""",
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    once = I.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"])
    return I.upsert(once, e.where("event_id % 3 = 0"), ["user_id", "event_type"], ["ts", "event_id"]).drop("event_id")


@query(
    "k4_coalescing_upsert",
    """WITH v AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN value END AS a, CASE WHEN event_type = 'purchase' THEN value END AS b FROM events)
    SELECT user_id, arg_min(a, ts) FILTER (a IS NOT NULL) AS a, arg_max(b, ts) FILTER (b IS NOT NULL) AS b, min(ts) AS first_ts, max(ts) AS last_ts FROM v GROUP BY 1""",
)
def coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    e = table(spark, sf_dir, "events").select("user_id", "ts", kind("signup").alias("a"), kind("purchase").alias("b"))
    return I.coalescing_upsert(e, ["user_id"], "ts", ["a"], ["b"])


@query(
    "k5_k6_children",
    """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS lines FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_orderkey IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""",
)
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    li = I.purge_stale(table(spark, sf_dir, "lineitem").select("l_orderkey"), o, "l_orderkey")
    return I.replace_children(li, o.where("o_orderstatus = 'P'").select("l_orderkey"), "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "s6_json_shapes",
    """SELECT o_orderkey, CAST(i AS INTEGER) AS place, l_partkey AS part, l_quantity AS qty FROM (SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i, l_partkey, l_quantity FROM lineitem)""",
)
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_shapes(table(spark, sf_dir, "lineitem"))


def _json_shapes(li: DataFrame) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    packed = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(items.alias("x")).select("o_orderkey", F.to_json(F.struct(F.col("x.l_partkey").alias("part"), F.col("x.l_quantity").alias("qty"))).alias("payload"))
    return I.columnar_rows(packed, "o_orderkey", "payload", "part array<bigint>, qty array<double>")


@query(
    "s8_i6_vintages",
    """WITH v AS (SELECT event_type AS s, user_id % 12 AS o, CAST(ts AS DATE) AS r, max(value) AS v FROM events GROUP BY 1, 2, 3), rel AS (SELECT DISTINCT s, r AS at FROM v),
    k AS (SELECT rel.s, rel.at, v.o, arg_max(v.v, v.r) AS v FROM rel JOIN v ON v.s = rel.s AND v.r <= rel.at GROUP BY 1, 2, 3), t AS (SELECT s, at, max(o) AS latest, arg_max(v, o) AS level, list(v ORDER BY o DESC)[2] AS before FROM k GROUP BY 1, 2)
    SELECT s, at AS r, latest, level, round(level - before, 6) AS period_change, round(level - lag(level) OVER (PARTITION BY s ORDER BY at), 6) AS release_delta FROM t""".replace("AS at", "AS day").replace(".at", ".day").replace("BY at", "BY day").replace(" at ", " day ").replace(" at,", " day,"),
)
def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("s"), (F.col("user_id") % 12).alias("o"), F.to_date("ts").alias("r"), F.col("value").alias("v"))
    out = I.vintage_replay(e, "s", "o", "r", "v").drop("revision_delta")
    return out.withColumns({c: F.round(c, 6) for c in ("period_change", "release_delta")})


@query(
    "i2_pending_queue",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N'))",
)
def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag").isin("A", "N"), "ok").otherwise("error").alias("status"))
    return I.pending(table(spark, sf_dir, "orders").select("o_orderkey"), ledger, "o_orderkey", retry=["error"])


@query(
    "i3_changed_groups",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 500 = 0)",
)
def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    before = E.group_digest(e.withColumn("value", F.when(F.col("event_id") % 500 != 0, F.col("value")).otherwise(F.col("value") + 1)), ["user_id"], ["event_id", "user_id", "value"])
    return E.changed_groups(e, ["user_id"], ["event_id", "user_id", "value"], before).select("event_id", "user_id")


@query(
    "i4_state_fold",
    """WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) / 86400e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT a.user_id, a.event_id, round(coalesce(sum(b.value * exp(-(a.t - b.t) / 5.0)), 0), 5) AS before, CAST(count(b.i) AS BIGINT) AS events_before FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.i < a.i GROUP BY 1, 2""",
)
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.decayed_state(e, ["user_id"], "ts", "event_id", "value", 5.0).withColumn("before", F.round("before", 5))


@query(
    "i11_budget_stop",
    "WITH b AS (SELECT user_id, event_id, value, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) SELECT user_id, event_id, round(b, 4) AS spent_before FROM b WHERE b < 100",
)
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.budget_stop(table(spark, sf_dir, "events"), "value", 100.0, ["user_id"], ["ts", "event_id"])
    return e.select("user_id", "event_id", F.round("spent_before", 4).alias("spent_before"))


@query(
    "p16_validation",
    "SELECT event_type, CAST(count(*) FILTER (value >= 0 AND value < 20) AS BIGINT) AS good, CAST(count(*) FILTER (NOT (value >= 0 AND value < 20)) AS BIGINT) AS bad FROM events GROUP BY 1",
)
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = I.validated(table(spark, sf_dir, "events"), {"not_negative": F.col("value") >= 0, "bounded": F.col("value") < 20})
    both = good.select("event_type", F.lit(1).alias("g")).unionByName(bad.select("event_type", F.lit(0).alias("g")))
    return both.groupBy("event_type").agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("bad"))


@query(
    "es_windows",
    """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2""",
)
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").alias("window_start"), "event_type", "n", "v")


@query(
    "es_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS session_start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, s""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.session_window("ts", "8 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query(
    "m1_ridge_walk_forward",
    f"""WITH {RETURNS}, b0 AS (SELECT entity, d, CASE WHEN r > 1 THEN 1 WHEN r < -1 THEN -1 ELSE r END AS r FROM returns), x AS (SELECT entity, d, year(d) AS y, r, lag(r) OVER w AS f, lead(d) OVER w AS e FROM b0 WINDOW w AS (PARTITION BY entity ORDER BY d)),
    c AS (SELECT x.*, coalesce(f, 0) AS f0 FROM x WHERE r IS NOT NULL AND e IS NOT NULL), yr AS (SELECT unnest([1996, 1997, 1998, 1999, 2000, 2001]) AS py),
    g AS (SELECT py, avg(f0) AS mf, avg(r) AS mr, sum(f0 * f0) - count(*) * avg(f0) * avg(f0) AS sxx, sum(f0 * r) - count(*) * avg(f0) * avg(r) AS sxy FROM c JOIN yr ON y >= py - 2 AND y < py AND year(e) < py GROUP BY 1)
    SELECT entity, d, round((mr - sxy / (sxx + 10.0) * mf) + sxy / (sxx + 10.0) * coalesce(f, 0), 6) AS prediction FROM x JOIN g ON y = py""",
)
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.operators.panel import ordered

    w = ordered("entity", "d")
    x = returns(spark, sf_dir)
    x = x.select("entity", "d", F.year("d").alias("y"), X.clip("r", -1.0, 1.0).alias("r"), X.clip(F.lag("r").over(w), -1.0, 1.0).alias("f"), F.lead("d").over(w).alias("e"))
    p = M.walk_forward(x, "y", "e", ["f"], "r", list(range(1996, 2002)), 2, 10.0)
    return p.select("entity", "d", F.round("prediction", 6).alias("prediction"))


@query(
    "m7_standardised",
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01') SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 5) AS l_quantity, round((l_discount - md) / sd, 5) AS l_discount FROM lineitem, s""",
)
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_shipdate")
    s = M.standardised(li, F.col("l_shipdate") < F.lit("1996-01-01"), ["l_quantity", "l_discount"])
    return s.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 5).alias("l_quantity"), F.round("l_discount", 5).alias("l_discount"))


@query("m6_alpha_grid")
def alpha_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")).select("y", "l_quantity", "l_discount", "l_tax", F.log("l_extendedprice").alias("t"))
    grid = M.choose_alpha(li, "y", [1995, 1996], [1997], ["l_quantity", "l_discount", "l_tax"], "t", [0.0, 1.0, 100.0, 1e4])
    return spark.createDataFrame([(a, round(e, 6)) for e, a in grid], "alpha double, mse double")


@query("m3_boosted_trees")
def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", F.log("l_extendedprice").alias("t"), "l_shipdate")
    model = M.boosted_trees(li.where(F.col("l_shipdate") < F.lit("1997-01-01")), ["l_quantity", "l_discount"], "t", 5, 3)
    return model.transform(li.where(F.col("l_shipdate") >= F.lit("1997-01-01"))).select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 6).alias("prediction"))


@query(
    "r7_candidate_selection",
    """WITH p AS (SELECT p_partkey, p_brand, ln(1 + p_retailprice) + 2.0 * p_size / 50 AS priority, CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 < 9 THEN 'validation' ELSE 'test' END AS split FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY priority DESC, p_partkey) AS rank FROM p)
    SELECT p_partkey, split, CAST(rank AS INTEGER) AS rank, round(priority, 6) AS priority FROM k WHERE rank <= CASE split WHEN 'train' THEN 70 WHEN 'validation' THEN 20 ELSE 10 END""",
)
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.operators.select import largest_remainder

    m = F.col("p_partkey") % 10
    p = table(spark, sf_dir, "part").select("p_partkey", (F.log1p("p_retailprice") + 2.0 * F.col("p_size") / 50).alias("priority"), F.when(m < 7, "train").when(m < 9, "validation").otherwise("test").alias("split"))
    shares = spark.createDataFrame([("train", 0.7), ("validation", 0.2), ("test", 0.1)], "split string, share double")
    w = Window.partitionBy("split").orderBy(F.col("priority").desc(), "p_partkey")
    k = p.withColumn("rank", F.row_number().over(w)).join(F.broadcast(largest_remainder(shares, "split", "share", 100)), "split")
    return k.where("rank <= quota").select("p_partkey", "split", "rank", F.round("priority", 6).alias("priority"))


@query("s11_articles")
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and prose of every page."""
    return extract_articles(table(spark, sf_dir, "pages"), "page_id", "html")


@query("s12_filing_texts")
def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page read as a filing whose description is its URL."""
    return extract_filings(table(spark, sf_dir, "pages"), "page_id", "html", "url")
