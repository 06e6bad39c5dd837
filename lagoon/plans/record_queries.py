"""Queries of records, ledgers, candidates, exports and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.operators import aggs as A
from lagoon.operators import ingest as I
from lagoon.operators import records as R
from lagoon.plans.agg_queries import SCORED, scored
from lagoon.plans.registry import query
from lagoon.plans.tables import table


@query(
    "i5_immutable_upsert",
    """WITH v AS (SELECT user_id, event_id, event_type, value, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, arg_min(event_id, row(new, event_id)) AS event_id, user_id % 7 AS born, arg_min(event_type, row(new, event_id)) AS event_type FROM v GROUP BY user_id""",
)
def immutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("user_id") % 7).alias("born"), "event_type")
    return R.immutable_upsert(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), "user_id", "event_id", ["born"], ["event_type"])


@query(
    "i12_reusable",
    """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN CAST(o_orderdate AS DATE) = last THEN n END AS n FROM orders JOIN (SELECT o_custkey AS c, CAST(max(o_orderdate) AS DATE) AS last, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) ON c = o_custkey""",
)
def reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return R.reusable(o, o.groupBy("o_custkey").agg(F.max("day").alias("day"), F.count(F.lit(1)).alias("n")), ["o_custkey"], "day", ["n"])


@query(
    "r18_ledger",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS began, coalesce(status, 'open') AS status, CAST(finished_at AS DATE) AS finished FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_linestatus, l_shipdate) AS status, max(l_shipdate) AS finished_at FROM (SELECT l_orderkey, l_shipdate, max(l_linestatus) AS l_linestatus FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2) GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("finished_at")).agg(F.max("l_linestatus").alias("status"))
    opened = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("began"))
    return R.ledger(opened, closed, "o_orderkey").withColumn("finished", F.to_date("finished_at")).drop("finished_at")


@query(
    "r37_failures",
    """WITH a AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS err FROM events), g AS (SELECT user_id, max(event_id) FILTER (err IS NULL) AS good, max(event_id) AS last FROM a GROUP BY 1)
    SELECT g.user_id, last, 'e' || last AS err, CAST(count(*) AS BIGINT) AS attempts FROM g JOIN a ON a.user_id = g.user_id AND (good IS NULL OR event_id > good) WHERE good IS NULL OR last > good GROUP BY 1, 2""",
)
def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("err"))
    return R.failures(e, ["user_id"], "event_id", "err")


@query(
    "r26_ticker_candidates",
    """WITH s AS (SELECT DISTINCT s_nationkey AS k, n_name AS s, r_name AS r FROM supplier JOIN nation ON n_nationkey = (s_suppkey * 7) % 30 JOIN region ON n_regionkey = r_regionkey)
    SELECT k, 'ticker' AS scope, upper(s) AS entity, 0.99 AS confidence, 'named' AS reason FROM s UNION ALL SELECT k, 'sector', r, 0.65, 'inherited from ' || min(upper(s)) FROM s GROUP BY k, r""",
)
def ticker_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.upper("n_name").alias("entity"), F.col("r_name").alias("sector"))
    named = table(spark, sf_dir, "supplier").join(n.select("n_nationkey", "n_name"), F.col("n_nationkey") == (F.col("s_suppkey") * 7) % 30)
    payload = named.groupBy(F.col("s_nationkey").alias("k")).agg(F.to_json(F.concat(F.collect_list(F.concat(F.lit(" "), F.lower("n_name"))), F.array(F.lit("unknown"), F.lit("")))).alias("payload"))
    return R.ticker_candidates(payload, "k", "payload", known, "entity", "sector", "named")


@query(
    "r33_article_dates",
    """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey - 1 END AS canon, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS eff FROM orders), s AS (SELECT coalesce(canon, id) AS article, min(CAST(l_shipdate AS DATE)) AS seen FROM lineitem JOIN a ON id = l_orderkey GROUP BY 1), o AS (SELECT id AS article, eff FROM a WHERE canon IS NULL)
    SELECT coalesce(o.article, s.article) AS article, coalesce(eff, seen) AS date FROM o FULL JOIN s ON o.article = s.article WHERE coalesce(eff, seen) IS NOT NULL""",
)
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 1, k - 1).alias("canon"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("eff"))
    return R.article_dates(a, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_shipdate"), "id", "canon", "eff", "l_shipdate")


@query(
    "r24_titles",
    """WITH d AS (SELECT l_orderkey, arg_min('part ' || l_partkey, row(l_linenumber, 'part ' || l_partkey)) FILTER (l_returnflag = 'A') AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(left(t, 8), 'order ' || l_orderkey) AS title FROM d""",
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("title", F.when(F.col("l_returnflag") == "A", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).otherwise(""))
    docs = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "title"))).alias("docs"))
    return docs.select("l_orderkey", R.first_title(F.col("docs"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")), 8).alias("title"))


@query(
    "x33_r36_union_ranked",
    """WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id AS url, event_id, event_type FROM events), a AS (SELECT d, url, event_id FROM e WHERE event_type = 'purchase'), b AS (SELECT d, url, event_id FROM e WHERE event_type = 'view' AND (d, url) NOT IN (SELECT (d, url) FROM a))
    SELECT url, min(event_id) AS event_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
)
def union_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.col("user_id").alias("url"), "event_id", "event_type")
    feed = lambda k: e.where(F.col("event_type") == k).drop("event_type")
    return R.ranked_ids(R.union_by_priority(feed("purchase"), feed("view"), "d", "url"), "url", "event_id")


@query(
    "a16_r30_daily_export",
    """WITH x AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, l_discount AS i, l_tax AS c, l_returnflag = 'A' AS direct FROM lineitem WHERE l_returnflag IN ('A', 'R'))
    SELECT k, d, CAST(count(*) FILTER (direct) AS DOUBLE) AS direct, CAST(count(*) FILTER (NOT direct) AS DOUBLE) AS distilled, round(CASE WHEN sum(c) <> 0 THEN sum(i * c) / sum(c) ELSE avg(i) END, 6) AS impact, CAST(NULL AS DOUBLE) AS absent FROM x GROUP BY 1, 2""",
)
def daily_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    direct = F.col("l_returnflag") == "A"
    day = x.groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d")).agg(F.count_if(direct).alias("direct"), F.count_if(~direct).alias("distilled"), F.round(A.weighted_mean("l_discount", "l_tax"), 6).alias("impact"))
    return R.exported(day.select("k", "d", F.to_json(F.struct("direct", "distilled", "impact")).alias("payload")), ["k", "d"], "payload", ["direct", "distilled", "impact", "absent"])


@query(
    "r16_availability",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE CAST(l_shipdate AS DATE) + TIME '23:59:59' END AS available_at, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'end_of_day' END AS available_quality FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'""",
)
def available(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", F.lit("accepted").alias("q"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return R.availability(li, f, "l_orderkey", "l_shipdate", "o_orderdate", "q").drop("l_shipdate")


@query("r19_universe", "SELECT DISTINCT upper(trim(c_mktsegment)) AS symbol FROM customer WHERE trim(c_mktsegment) <> ''")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.universe(table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("s")), "s")


@query(
    "m2_ridge_probes",
    """WITH t AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y1, l_tax AS y2 FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'),
    g AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, avg(y1) AS m1, avg(y2) AS m2, corr(a, b) AS r, covar_pop(a, y1) / stddev_pop(a) AS a1, covar_pop(b, y1) / stddev_pop(b) AS b1, covar_pop(a, y2) / stddev_pop(a) AS a2, covar_pop(b, y2) / stddev_pop(b) AS b2 FROM t),
    s AS (SELECT *, n + 100 AS p, n * r AS q FROM g), w AS (SELECT *, n * (p * a1 - q * b1) / (p * p - q * q) AS wa1, n * (p * b1 - q * a1) / (p * p - q * q) AS wb1, n * (p * a2 - q * b2) / (p * p - q * q) AS wa2, n * (p * b2 - q * a2) / (p * p - q * q) AS wb2 FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, round(m1 + wa1 * (l_quantity - ma) / sa + wb1 * (l_discount - mb) / sb, 3) AS predicted_l_extendedprice, round(m2 + wa2 * (l_quantity - ma) / sa + wb2 * (l_discount - mb) / sb, 7) AS predicted_l_tax FROM lineitem, w""",
)
def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.ridge_probes(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"], F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"), 100.0)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round("predicted_l_extendedprice", 3).alias("predicted_l_extendedprice"), F.round("predicted_l_tax", 7).alias("predicted_l_tax"))


@query(
    "m8_latest_scores",
    f"""WITH {SCORED}, l AS (SELECT entity, d, 0.5 * score - 0.001 * volume + 0.25 AS p, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS n FROM scored) SELECT entity, d, round(p, 6) AS prediction, CAST(rank() OVER (ORDER BY p DESC, entity) AS INTEGER) AS rank FROM l WHERE n = 1""",
)
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.latest_scores(scored(spark, sf_dir), "entity", "d", ["score", "volume"], 0.25, [0.5, -0.001])
    return x.withColumn("prediction", F.round("prediction", 6))


@query("r12_signature", "SELECT CAST(count(*) AS BIGINT) AS rows, TRUE AS same, FALSE AS other FROM orders")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    a = R.signature(o, cols)
    b = R.signature(o.repartition(7, "o_custkey"), cols).select(F.col("digest").alias("again"))
    c = R.signature(o.withColumn("o_totalprice", F.col("o_totalprice") + 1), cols).select(F.col("digest").alias("changed"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select("rows", (F.col("digest") == F.col("again")).alias("same"), (F.col("digest") == F.col("changed")).alias("other"))


@query(
    "s7_nested_facts",
    """SELECT l_orderkey, 'line' AS taxonomy, l_returnflag AS tag, l_linestatus AS unit, l_linenumber AS n, l_quantity AS val FROM lineitem WHERE l_returnflag <> 'N'""",
)
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    units = li.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("val"))).alias("f"))
    tags = units.groupBy("l_orderkey", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "f"))).alias("units"))
    body = tags.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_returnflag"), F.struct(F.lit("x").alias("label"), "units")))).alias("tags"))
    payload = body.select("l_orderkey", F.to_json(F.create_map(F.lit("line"), F.col("tags"))).alias("payload"))
    return I.nested_facts(payload, "l_orderkey", "payload", "struct<n:int,val:double>", ["A", "R"])


@query(
    "s8_wide_vintages",
    """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1) SELECT 'QTY' AS series, d, DATE '2020-01-31' AS realtime_start, a AS value FROM d WHERE a IS NOT NULL UNION ALL SELECT 'QTY', d, DATE '2020-02-29', b FROM d WHERE b IS NOT NULL""",
)
def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    d = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(flag("A").alias("QTY_20200131"), flag("R").alias("QTY_20200229"))
    return I.wide_vintages(d, "d")


@query("a25_coverage", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (l_discount <> 0 OR l_tax <> 0) AS BIGINT) AS active, round(count(*) FILTER (l_discount <> 0 OR l_tax <> 0) / count(*), 6) AS share FROM lineitem")
def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]).withColumn("share", F.round("share", 6))


@query(
    "r8_r35_feature_matrix",
    """SELECT vec_id, CAST(len(embedding) + 2 AS INTEGER) AS width, round(list_sum(embedding) + vec_id % 3 + 1, 4) AS total FROM embeddings WHERE embedding IS NOT NULL""",
)
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").withColumns({"a": (F.col("vec_id") % 3).cast("double"), "b": F.lit(1.0)})
    names = R.feature_set({"near": ["a"], "far": ["b", "a"]}, "near+far")
    wide = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(*names))
    return e.select("vec_id", F.size(wide).alias("width"), F.round(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))




@query(
    "r15_object_rows",
    """SELECT o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS reported, CASE WHEN o_orderkey % 7 > 0 THEN date_trunc('day', o_orderdate) + INTERVAL 86399 SECOND ELSE TIMESTAMP '2024-05-06 07:08:09' END AS available_at FROM orders""",
)
def object_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5 > 0, F.format_string("%.2f", "o_totalprice")).otherwise("None")
    reported = F.when(F.col("o_orderkey") % 7 > 0, F.to_date("o_orderdate").cast("string")).otherwise("-")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(F.struct(price.alias("price"), reported.alias("reported"))).alias("rows"))).alias("payload"))
    out = I.object_rows(o.withColumn("at", F.lit("2024-05-06 07:08:09")), "o_custkey", "payload", "rows", ["price"], ["reported"], "at", "reported")
    return out.drop("place")
