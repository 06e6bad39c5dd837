"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.operators import joins as J
from lagoon.operators.calendar import decision_session, deferred, next_session
from lagoon.plans.registry import query
from lagoon.plans.tables import RETURNS, returns, sectors, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


@query(
    "j1_j9_inner_joins",
    """SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2""",
)
def inner_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    big = li.join(o.where("o_orderdate >= timestamp '1997-01-01'"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    # revenue per nation key first: the dimensions meet 25 rows
    by_nation = big.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    named = by_nation.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "n_name", "lines", F.round("revenue", 2).alias("revenue"))


@query(
    "j2_j3_checked_join",
    "SELECT c_custkey, c_mktsegment, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.checked_join(table(spark, sf_dir, "customer"), n, ["c_nationkey"], "left", "many_to_one").select("c_custkey", "c_mktsegment", "n_name")


@query(
    "j4_asof_join",
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
    r AS (SELECT user_id, ts, event_id AS source, value FROM events WHERE event_type = (SELECT max(event_type) FROM events)),
    p AS (SELECT l.event_id, l.user_id, l.ts, arg_max(row(r.source, r.value, r.ts), row(r.ts, r.source)) AS m FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts <= l.ts GROUP BY 1, 2, 3)
    SELECT event_id, user_id, m[1] AS source, m[2] AS value, CAST(date_diff('day', CAST(m[3] AS DATE), CAST(ts AS DATE)) AS INTEGER) AS age FROM p""",
)
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.join(F.broadcast(ends))
    left = e.where("event_type = lo").select("event_id", "user_id", "ts")
    right = e.where("event_type = hi").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("source"), "value")
    return J.asof_join(left, right, ["user_id"], "ts", "rts", ["source", "value"], ["source"], age="age").drop("ts")


@query(
    "j5_j6_next_session",
    """WITH s AS (SELECT d, lag(d) OVER (ORDER BY d) AS after FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5))
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS day, (SELECT min(d) FROM s WHERE d > CAST(l_shipdate AS DATE)) AS trade_date FROM lineitem""",
)
def following_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _following(spark, sf_dir, table(spark, sf_dir, "lineitem"))


def _following(spark: SparkSession, sf_dir: str, li: DataFrame) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).where("weekday(d) < 5").distinct()
    return next_session(li.select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day")), "day", s, "d")


@query(
    "j7_decision_session",
    """WITH s AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-29', INTERVAL 1 DAY)) AS DATE) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5),
    e AS (SELECT event_id, ts - INTERVAL 5 HOUR AS t FROM events),
    w AS (SELECT event_id, t, (SELECT i FROM s WHERE d = CAST(t AS DATE)) AS here, (SELECT min(i) FROM s WHERE d > CAST(t AS DATE)) AS nxt FROM e),
    k AS (SELECT event_id, CASE WHEN here IS NOT NULL AND hour(t) < 16 THEN here + 1 WHEN here IS NOT NULL THEN here + 2 ELSE nxt + 1 END AS want FROM w)
    SELECT event_id, d AS trade_date FROM k LEFT JOIN s ON i = want""",
)
def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.operators.calendar import day_range

    s = day_range(spark, "2024-01-01", "2024-01-29", "d").where("weekday(d) < 5")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return decision_session(e, "ts", s, "d").select("event_id", "trade_date")


@query(
    "i8_deferred_rows",
    """WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20')
    SELECT CAST(count(*) FILTER (m IS NULL) AS BIGINT) AS deferred, CAST(count(*) FILTER (m IS NOT NULL) AS BIGINT) AS placed FROM (SELECT (SELECT min(d) FROM s WHERE d > CAST(ts AS DATE)) AS m FROM events)""",
)
def deferral(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return deferred(next_session(e, "day", e.where("day < '2024-01-20'").select("day"), "day"))


@query(
    "j8_scoped_join",
    f"""WITH {RETURNS}, u AS (SELECT sector AS e, d, avg(r) AS f FROM returns GROUP BY 1, 2), m AS (SELECT d, avg(r) AS f FROM returns GROUP BY d), t AS (SELECT entity, d, r AS f FROM returns WHERE entity % 3 = 0)
    SELECT b.entity, b.d, round(coalesce(t.f, 0), 6) AS ticker__f, round(coalesce(u.f, 0), 6) AS sector__f, round(coalesce(m.f, 0), 6) AS market__f
    FROM returns b LEFT JOIN t ON t.entity = b.entity AND t.d = b.d LEFT JOIN u ON u.e = b.sector AND u.d = b.d LEFT JOIN m ON m.d = b.d""",
)
def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = returns(spark, sf_dir)
    block = lambda df, scope, e: df.select("d", F.lit(scope).alias("scope"), e.cast("string").alias("e"), "f")
    f = block(x.where("entity % 3 = 0").withColumnRenamed("r", "f"), "ticker", F.col("entity"))
    f = f.unionByName(block(x.groupBy("sector", "d").agg(F.avg("r").alias("f")), "sector", F.col("sector")))
    f = f.unionByName(block(x.groupBy("d").agg(F.avg("r").alias("f")), "market", F.lit("all")))
    x = x.withColumn("name", F.col("entity").cast("string"))
    out = J.scoped_join(x, f, "d", {"ticker": "name", "sector": "sector", "market": None}, "scope", "e", ["f"], "d")
    return out.select("entity", "d", *[F.round(c, 6).alias(c) for c in ("ticker__f", "sector__f", "market__f")])


@query(
    "j10_j22_event_study",
    f"""WITH {RETURNS}, m AS (SELECT d, avg(r) AS m FROM returns GROUP BY d), x AS (SELECT r.entity, r.d, r.r, m.m, lead(r.r, 1) OVER w AS r1, lead(m.m, 1) OVER w AS m1, lead(r.r, 4) OVER w AS r4, lead(m.m, 4) OVER w AS m4 FROM returns r JOIN m USING (d) WINDOW w AS (PARTITION BY r.entity ORDER BY r.d)),
    n AS (SELECT DISTINCT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)
    SELECT entity, d, round(r1 - m1, 6) AS a1, round(r4 - m4, 6) AS a4 FROM n JOIN x USING (entity, d)""",
)
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.operators.panel import ordered

    x = returns(spark, sf_dir)
    w = ordered("entity", "d")
    x = x.join(x.groupBy("d").agg(F.avg("r").alias("m")), "d")
    lead = lambda k: F.round(F.lead("r", k).over(w) - F.lead("m", k).over(w), 6)
    x = x.select("entity", "d", lead(1).alias("a1"), lead(4).alias("a4"))
    n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity = 50").select(F.col("l_suppkey").alias("entity"), F.date_trunc("week", "l_shipdate").cast("date").alias("d")).distinct()
    return n.join(x, ["entity", "d"])


@query(
    "j11_paired_days",
    f"""WITH {RETURNS}, a AS (SELECT d, avg(r) AS a FROM returns WHERE sector = 'ASIA' GROUP BY d), b AS (SELECT d, avg(r) AS b FROM returns WHERE sector = 'EUROPE' GROUP BY d)
    SELECT d, round(a - b, 6) AS lift FROM a JOIN b USING (d)""",
)
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = returns(spark, sf_dir).where("sector in ('ASIA', 'EUROPE')")
    # one aggregation with both sides instead of a self-join
    side = lambda s: F.avg(F.when(F.col("sector") == s, F.col("r")))
    both = x.groupBy("d").agg(side("ASIA").alias("a"), side("EUROPE").alias("b"), F.count_distinct("sector").alias("n"))
    return both.where("n = 2").select("d", F.round(F.col("a") - F.col("b"), 6).alias("lift"))


@query(
    "j12_j27_canonical_copies",
    """WITH c AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents),
    p AS (SELECT doc_id, source, CASE WHEN canonical < doc_id THEN canonical END AS canonical FROM c)
    SELECT coalesce(canonical, doc_id) AS root, CAST(count(*) AS BIGINT) AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM p GROUP BY 1 HAVING count(*) > 1""",
)
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.operators.text import exact_parents

    p = exact_parents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", F.sha2("text", 256))
    return p.groupBy(F.coalesce("canonical", "doc_id").alias("root")).agg(F.count(F.lit(1)).alias("copies"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).where("copies > 1")


@query(
    "j13_j15_semi_anti",
    """SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS idle FROM customer c WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey IN (1, 2))
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY 1""",
)
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    c = c.join(n.where("n_regionkey in (1, 2)"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    c = c.join(o.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("idle"))


@query(
    "j16_interval_join",
    """WITH v AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS valid_from, lead(CAST(o_orderdate AS DATE) - 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders),
    f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN valid_from END AS valid_from, valid_to FROM v),
    p AS (SELECT c_custkey, DATE '1996-06-01' + CAST(c_custkey % 300 AS INTEGER) AS day FROM customer)
    SELECT c_custkey, day, o_orderkey FROM p JOIN f ON c_custkey = o_custkey AND (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR day <= valid_to)""",
)
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.to_date("o_orderdate").alias("valid_from"), "o_orderdate")
    w = Window.partitionBy("c_custkey").orderBy("o_orderdate", "o_orderkey")
    o = o.withColumn("valid_to", F.date_sub(F.lead("valid_from").over(w), 1)).withColumn("valid_from", F.when(F.col("o_orderkey") % 7 != 0, F.col("valid_from")))
    p = table(spark, sf_dir, "customer").select("c_custkey", F.date_add(F.lit("1996-06-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).alias("day"))
    return J.interval_join(p, o, ["c_custkey"], "day", "valid_from", "valid_to").select("c_custkey", "day", "o_orderkey")


@query(
    "j16_bucketed_interval_join",
    """WITH v AS (SELECT n_nationkey, DATE '1992-01-01' + n_nationkey * 60 AS a, CASE WHEN n_nationkey % 5 > 0 THEN DATE '1992-01-01' + n_nationkey * 60 + 400 END AS b FROM nation),
    o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, n_nationkey FROM o JOIN v ON d >= a AND (b IS NULL OR d <= b)""",
)
def bucketed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir, table(spark, sf_dir, "orders"))


def _bucketed(spark: SparkSession, sf_dir: str, o: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    begin = F.date_add(F.lit("1992-01-01").cast("date"), n * 60)
    v = table(spark, sf_dir, "nation").select("n_nationkey", begin.alias("a"), F.when(n % 5 > 0, F.date_add(begin, 400)).alias("b"))
    return J.interval_join(o.select("o_orderkey", F.to_date("o_orderdate").alias("d")), v, [], "d", "a", "b").select("o_orderkey", "n_nationkey")


@query(
    "j17_j18_containment",
    r"""WITH a AS (SELECT DISTINCT lower(c) AS alias FROM (SELECT unnest(['the mit license', 'Apache License', 'GNU General Public License', 'all rights', 'license']) AS c)),
    t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)
    SELECT doc_id, alias FROM t JOIN a ON contains(t, ' ' || alias || ' ')""",
)
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame([("the mit license",), ("Apache License",), ("GNU General Public License",), ("all rights",), ("license",)], "c string")
    hit = J.containment_join(table(spark, sf_dir, "documents"), "text", a.select(F.lower("c").alias("alias")), "alias", ["doc_id"])
    return hit.select("doc_id", "alias").distinct()


@query(
    "j19_name_resolution",
    r"""WITH n AS (SELECT unnest(['nation 7', 'NATION-3', 'The Nation 12 Inc', 'nation', 'nation 2 4', 'nation 5 of company']) AS name),
    f AS (SELECT name, array_to_string(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'), ' ') AS norm, list_distinct(list_filter(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'), lambda x: x NOT IN ('inc', 'corp', 'the', 'of', 'company'))) AS t FROM n),
    e AS (SELECT n_nationkey AS entity, array_to_string(regexp_extract_all(lower(n_name), '[\p{L}\p{N}]+'), ' ') AS enorm, list_distinct(regexp_extract_all(lower(n_name), '[\p{L}\p{N}]+')) AS et FROM nation),
    x AS (SELECT name, min(entity) AS entity, count(*) AS k FROM f JOIN e ON norm = enorm GROUP BY name),
    z AS (SELECT name, min(entity) AS entity, count(*) AS k FROM f JOIN e ON (list_has_all(et, t) OR list_has_all(t, et)) AND least(len(t), len(et)) >= 2 AND len(list_intersect(t, et)) / len(list_distinct(list_concat(t, et))) >= 0.6
      WHERE name NOT IN (SELECT name FROM x) GROUP BY name)
    SELECT name, entity, 'exact' AS how FROM x WHERE k = 1 UNION ALL SELECT name, entity, 'fuzzy' FROM z WHERE k = 1""",
)
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.createDataFrame([(x,) for x in ("nation 7", "NATION-3", "The Nation 12 Inc", "nation", "nation 2 4", "nation 5 of company")], "name string")
    return J.resolve_names(n, "name", table(spark, sf_dir, "nation"), "n_nationkey", "n_name", ["inc", "corp", "the", "of", "company"])


@query(
    "j20_similarity_pairs",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
    SELECT a.label, a.vec_id AS "left", b.vec_id AS "right", round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.3""",
)
def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = J.similarity_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", None, 0.3)
    return p.withColumn("score", F.round("score", 6))


@query(
    "j23_full_outer_merge",
    """WITH a AS (SELECT CAST(ts AS DATE) AS d, user_id, sum(value) AS x FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), b AS (SELECT CAST(ts AS DATE) AS d, user_id, count(*) AS y FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
    SELECT coalesce(a.d, b.d) AS d, coalesce(a.user_id, b.user_id) AS user_id, round(coalesce(x, 0), 6) AS x, CAST(coalesce(y, 0) AS BIGINT) AS y FROM a FULL JOIN b ON a.d = b.d AND a.user_id = b.user_id""",
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two feeds of which each event enters one
    e = _events(spark, sf_dir).withColumnRenamed("day", "d")
    return _merged(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"))


def _merged(summed: DataFrame, counted: DataFrame) -> DataFrame:
    a = summed.groupBy("d", "user_id").agg(F.sum("value").alias("x"))
    b = counted.groupBy("d", "user_id").agg(F.count(F.lit(1)).alias("y"))
    return J.checked_join(a, b, ["d", "user_id"], "full_outer", "one_to_one").na.fill(0).withColumn("x", F.round("x", 6))


@query(
    "j24_label_overlay",
    "SELECT doc_id, coalesce(l.quality, CAST(n_chars > 1000 AS INTEGER)) AS quality, l.quality IS NOT NULL AS direct FROM documents LEFT JOIN labels l USING (doc_id)",
)
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce("quality", (F.col("n_chars") > 1000).cast("int")).alias("quality"), F.col("quality").isNotNull().alias("direct"))


@query(
    "j26_key_mapping",
    """SELECT upper(replace(p_brand, '#', '-')) AS symbol, CAST(count(*) AS BIGINT) AS parts, CAST(count(*) FILTER (s_suppkey IS NULL) AS BIGINT) AS unresolved FROM part LEFT JOIN supplier ON s_suppkey = p_size GROUP BY 1""",
)
def key_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier").select("s_suppkey")
    x = p.join(s, F.col("p_size") == F.col("s_suppkey"), "left")
    return x.groupBy(F.upper(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("symbol")).agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("s_suppkey").isNull()).alias("unresolved"))


@query(
    "j28_interactions",
    f"""WITH {RETURNS}, m AS (SELECT d, avg(r) AS m, avg(volume) AS v FROM returns GROUP BY d)
    SELECT d, sector, round(m, 6) AS m, round(v, 6) AS v FROM m CROSS JOIN (SELECT DISTINCT sector FROM sectors)""",
)
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sectors are a dimension of five: columns, then rows
    m = returns(spark, sf_dir).groupBy("d").agg(F.avg("r").alias("m"), F.avg("volume").alias("v"))
    s = sectors(spark, sf_dir).agg(F.array_sort(F.collect_set("sector")).alias("s"))
    return m.join(F.broadcast(s)).select("d", F.explode("s").alias("sector"), F.round("m", 6).alias("m"), F.round("v", 6).alias("v"))
