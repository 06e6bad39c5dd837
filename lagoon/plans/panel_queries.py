"""Queries over the weekly panel: lags, rolling windows, ranks, recursive means, drawdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lagoon.operators import panel as P
from lagoon.plans.registry import query
from lagoon.plans.tables import BARS, RETURNS, bars, returns, table

def _w() -> WindowSpec:
    """Rows of an entity in time order; made when a query is, since it needs a session."""
    return P.ordered("entity", "d")


def _r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


@query(
    "flagship_weekly_spread",
    f"""WITH {BARS},
    f AS (SELECT entity, d, open, close, close / nullif(lag(close) OVER w, 0) - 1 AS r1, lead(close, 1) OVER w AS next_close, lead(open, 1) OVER w AS next_open FROM bars WINDOW w AS (PARTITION BY entity ORDER BY d)),
    v AS (SELECT *, CASE WHEN count(r1) OVER w >= 5 THEN stddev_samp(r1) OVER w END AS vol FROM f WINDOW w AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    s AS (SELECT entity, d, r1 / nullif(vol, 0) AS signal, next_close / nullif(next_open, 0) - 1 AS target FROM v),
    k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY signal, entity) AS up, row_number() OVER (PARTITION BY d ORDER BY signal DESC, entity) AS down, count(*) OVER (PARTITION BY d) AS n FROM s WHERE signal IS NOT NULL AND target IS NOT NULL)
    SELECT d, CAST(max(n) AS BIGINT) AS names, round(avg(target) FILTER (down <= greatest(1, n // 10)) - avg(target) FILTER (up <= greatest(1, n // 10)), 6) AS spread
    FROM k WHERE n >= 5 GROUP BY d""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.operators.select import tails

    b = bars(spark, sf_dir).withColumn("r1", P.change("close", 1, _w())).withColumn("vol", P.rolling(F.stddev_samp, "r1", 20, 5, _w()))
    b = b.withColumns({"signal": F.try_divide("r1", F.nullif("vol", F.lit(0.0))), "target": F.try_divide(F.lead("close").over(_w()), F.nullif(F.lead("open").over(_w()), F.lit(0.0))) - 1})
    t = tails(b.where("signal is not null and target is not null"), "signal", ["d"], "entity", 0.1).where("names >= 5")
    return t.groupBy("d").agg(F.max("names").cast("bigint").alias("names"), _r(F.avg(F.when(F.col("side") == 1, F.col("target"))) - F.avg(F.when(F.col("side") == -1, F.col("target"))), "spread"))


@query(
    "w1_w2_lag_lead",
    f"""WITH {BARS} SELECT entity, d, lag(close, 1) OVER w AS close__lag1, lag(close, 5) OVER w AS close__lag5, lag(volume, 1) OVER w AS volume__lag1, lag(volume, 5) OVER w AS volume__lag5, lead(d, 4) OVER w AS target_end, round(lead(close, 4) OVER w / nullif(lead(open, 1) OVER w, 0) - 1, 6) AS target
    FROM bars WINDOW w AS (PARTITION BY entity ORDER BY d)""",
)
def lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.lags(bars(spark, sf_dir), ["close", "volume"], [1, 5], "entity", "d")
    target = F.try_divide(F.lead("close", 4).over(_w()), F.nullif(F.lead("open", 1).over(_w()), F.lit(0.0))) - 1
    return b.withColumns({"target_end": F.lead("d", 4).over(_w()), "target": F.round(target, 6)}).drop("open", "close", "volume")


@query(
    "w3_pct_change",
    f"""WITH {BARS}, c AS (SELECT entity, d, close / nullif(lag(close, 1) OVER w, 0) - 1 AS c1, close / nullif(lag(close, 5) OVER w, 0) - 1 AS c5 FROM bars WINDOW w AS (PARTITION BY entity ORDER BY d))
    SELECT entity, d, round(c1, 6) AS c1, round(ln(1 + c5), 6) AS l5 FROM c""",
)
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("entity", "d", _r(P.change("close", 1, _w()), "c1"), _r(P.log_return("close", 5, _w()), "l5"))


@query(
    "w4_w6_rolling",
    f"""WITH {RETURNS} SELECT entity, d,
      round(CASE WHEN count(close) OVER w20 >= 5 THEN avg(close) OVER w20 END, 3) AS mean20,
      round(CASE WHEN count(r) OVER w20 >= 5 THEN stddev_samp(r) OVER w20 END, 6) AS vol20,
      round(CASE WHEN count(r) OVER w20 >= 5 THEN stddev_samp(CASE WHEN r < 0 THEN r WHEN r IS NOT NULL THEN 0 END) OVER w20 END, 6) AS downside20,
      CASE WHEN count(close) OVER w63 >= 20 THEN max(close) OVER w63 END AS high63,
      round(CASE WHEN count(close) OVER w63 >= 20 THEN close / max(close) OVER w63 - 1 END, 6) AS off_high63
    FROM returns WINDOW w20 AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w63 AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""",
)
def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.functions.exprs import clip

    x, high = returns(spark, sf_dir), P.rolling(F.max, "close", 63, 20, _w())
    return x.select("entity", "d", _r(P.rolling(F.avg, "close", 20, 5, _w()), "mean20", 3), _r(P.rolling(F.stddev_samp, "r", 20, 5, _w()), "vol20"), _r(P.rolling(F.stddev_samp, clip("r", None, 0.0), 20, 5, _w()), "downside20"), high.alias("high63"), _r(F.col("close") / high - 1, "off_high63"))


@query(
    "w8_zscore",
    f"""WITH {BARS} SELECT entity, d, round((volume - CASE WHEN count(volume) OVER w >= 5 THEN avg(volume) OVER w END) / (CASE WHEN count(volume) OVER w >= 5 THEN stddev_samp(volume) OVER w END + 1e-8), 6) AS z
    FROM bars WINDOW w AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("entity", "d", _r(P.zscore("volume", 20, 5, _w()), "z"))


@query(
    "w9_prior_zscore",
    f"""WITH {BARS}, s AS (SELECT entity, d, volume,
      coalesce(CASE WHEN count(volume) OVER a >= 6 THEN avg(volume) OVER a END, CASE WHEN count(volume) OVER b >= 6 THEN avg(volume) OVER b END) AS m,
      coalesce(CASE WHEN count(volume) OVER a >= 6 THEN stddev_samp(volume) OVER a END, CASE WHEN count(volume) OVER b >= 6 THEN stddev_samp(volume) OVER b END) AS s
      FROM bars WINDOW a AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY entity ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT entity, d, round(CASE WHEN m IS NOT NULL AND nullif(s, 0) IS NOT NULL THEN greatest(-5, least(5, (volume - m) / nullif(s, 0))) END, 6) AS z FROM s""",
)
def prior_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("entity", "d", _r(P.prior_zscore("volume", _w()), "z"))


@query(
    "w10_trailing_percentile",
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) AS i FROM bars),
    j AS (SELECT a.entity, a.d, count(*) AS n, count(*) FILTER (b.close <= a.close) AS k FROM n a JOIN n b ON b.entity = a.entity AND b.i BETWEEN a.i - 52 AND a.i - 1 GROUP BY 1, 2)
    SELECT b.entity, b.d, round(CASE WHEN n >= 20 THEN k / n END, 6) AS p FROM bars b LEFT JOIN j USING (entity, d)""",
)
def trailing_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("entity", "d", _r(P.trailing_percentile("close", _w(), 52, 20), "p"))


@query(
    "w11_lagged_shock",
    f"""WITH {BARS}, c AS (SELECT entity, d, close / nullif(lag(close, 5) OVER w, 0) - 1 AS c FROM bars WINDOW w AS (PARTITION BY entity ORDER BY d)),
    z AS (SELECT entity, d, (c - CASE WHEN count(c) OVER a >= 10 THEN avg(c) OVER a END) / nullif(CASE WHEN count(c) OVER a >= 10 THEN stddev_samp(c) OVER a END, 0) AS z FROM c WINDOW a AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))
    SELECT entity, d, round(lag(z) OVER (PARTITION BY entity ORDER BY d), 6) AS shock FROM z""",
)
def lagged_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("c", P.change("close", 5, _w())).withColumn("z", P.prior_zscore("c", _w(), 52, 10, None, fallback=False))
    return b.select("entity", "d", _r(F.lag("z").over(_w()), "shock"))


@query(
    "w12_rolling_beta",
    f"""WITH {RETURNS}, m AS (SELECT *, avg(r) OVER (PARTITION BY d) AS x FROM returns),
    b AS (SELECT entity, d, (CASE WHEN count(r * x) OVER w >= 10 THEN avg(r * x) OVER w END - CASE WHEN count(r) OVER w >= 10 THEN avg(r) OVER w END * CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w END) / nullif(CASE WHEN count(x) OVER w >= 10 THEN var_samp(x) OVER w END, 0) AS b
      FROM m WINDOW w AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
    SELECT entity, d, round(lag(CASE WHEN b IS NOT NULL THEN greatest(-5, least(5, b)) END) OVER (PARTITION BY entity ORDER BY d), 6) AS beta FROM b""",
)
def rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = returns(spark, sf_dir).withColumn("x", F.avg("r").over(Window.partitionBy("d")))
    return P.add_beta(x, "r", "x", _w(), 52, 10, "beta").select("entity", "d", _r(F.col("beta"), "beta"))


@query(
    "w13_macd",
    f"""WITH {BARS}, p AS (SELECT entity, list(d ORDER BY d) AS ds, list(close ORDER BY d) AS x FROM bars GROUP BY entity),
    e AS (SELECT entity, ds, x, [list_reduce(x[1:i], lambda y, v: v * (2.0 / 13) + y * (1 - 2.0 / 13)) - list_reduce(x[1:i], lambda y, v: v * (2.0 / 27) + y * (1 - 2.0 / 27)) FOR i IN range(1, len(x) + 1)] AS macd FROM p),
    s AS (SELECT entity, ds, x, macd, [list_reduce(macd[1:i], lambda y, v: v * (2.0 / 10) + y * (1 - 2.0 / 10)) FOR i IN range(1, len(x) + 1)] AS sig FROM e)
    SELECT entity, d, round((m - g) / nullif(c, 0), 6) AS hist FROM (SELECT entity, unnest(ds) AS d, unnest(macd) AS m, unnest(sig) AS g, unnest(x) AS c FROM s)""",
)
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.ema(bars(spark, sf_dir).select("entity", "d", "close"), {"fast": ("close", 12), "slow": ("close", 26)}, ["entity"], ["d"])
    b = P.ema(b.withColumn("macd", F.col("fast") - F.col("slow")), {"sig": ("macd", 9)}, ["entity"], ["d"])
    return b.select("entity", "d", _r(F.try_divide(F.col("macd") - F.col("sig"), F.nullif("close", F.lit(0.0))), "hist"))


@query(
    "w14_rsi",
    f"""WITH {BARS}, d AS (SELECT entity, d, close - lag(close) OVER (PARTITION BY entity ORDER BY d) AS x FROM bars),
    m AS (SELECT entity, d, CASE WHEN count(x) OVER w >= 5 THEN avg(CASE WHEN x > 0 THEN x WHEN x IS NOT NULL THEN 0 END) OVER w END AS u, CASE WHEN count(x) OVER w >= 5 THEN avg(CASE WHEN x < 0 THEN -x WHEN x IS NOT NULL THEN 0 END) OVER w END AS l FROM d WINDOW w AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT entity, d, round((100 * u / nullif(u + l, 0) - 50) / 50, 6) AS rsi FROM m""",
)
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.add_rsi(bars(spark, sf_dir), "close", "entity", "d").select("entity", "d", _r(F.col("rsi"), "rsi"))


@query(
    "w7_w15_w16_w17_densify",
    """WITH days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d),
    agg AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, sum(value) AS v FROM events WHERE event_type = 'purchase' OR event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2),
    dense AS (SELECT u.user_id, days.d, coalesce(n, 0) AS n, v, row_number() OVER (PARTITION BY u.user_id ORDER BY days.d) AS i FROM (SELECT DISTINCT user_id FROM agg) u CROSS JOIN days LEFT JOIN agg ON agg.user_id = u.user_id AND agg.d = days.d),
    s AS (SELECT *, max(CASE WHEN n > 0 THEN i END) OVER (PARTITION BY user_id ORDER BY d) AS last FROM dense)
    SELECT user_id, d, CAST(sum(n) OVER w5 AS BIGINT) AS n5, CAST(sum(n) OVER w20 AS BIGINT) AS n20, CAST(least(coalesce(i - last, 20), 20) AS INTEGER) AS age,
      round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS filled,
      round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * exp(-least(coalesce(i - last, 20), 20) / 5.0), 6) AS worn
    FROM s WINDOW w5 AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.operators.calendar import densify, day_range

    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first"))
    e = e.join(F.broadcast(first), (F.col("event_type") == "purchase") | (F.col("event_type") == F.col("first")), "left_semi")
    daily = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    dense = densify(daily, day_range(spark, "2024-01-01", "2024-01-31", "d"), ["user_id"], "d", {"n": 0})
    w = P.ordered("user_id", "d")
    dense = P.add_rows_since(dense, "age", F.col("n") > 0, "user_id", "d", 20)
    return dense.select(
        "user_id",
        "d",
        F.sum("n").over(w.rowsBetween(-4, 0)).cast("bigint").alias("n5"),
        F.sum("n").over(w.rowsBetween(-19, 0)).cast("bigint").alias("n20"),
        F.col("age").cast("int").alias("age"),
        _r(P.forward_fill("v", w, 3), "filled"),
        _r(P.decay(P.forward_fill("v", w), "age", 5.0), "worn"),
    )


@query(
    "w18_w21_ranks",
    f"""WITH {RETURNS}, k AS (SELECT *, CASE WHEN r IS NOT NULL THEN (rank() OVER (PARTITION BY d ORDER BY r NULLS LAST) + (count(r) OVER (PARTITION BY d, r) - 1) / 2.0) / count(r) OVER (PARTITION BY d) END AS p,
      CASE WHEN r IS NOT NULL THEN (rank() OVER (PARTITION BY d, sector ORDER BY r NULLS LAST) + (count(r) OVER (PARTITION BY d, sector, r) - 1) / 2.0) / count(r) OVER (PARTITION BY d, sector) END AS ps FROM returns)
    SELECT entity, d, round(coalesce(p - 0.5, 0), 6) AS centred, round(p - avg(p) OVER (PARTITION BY d), 6) AS zero_mean, round(ps, 6) AS in_sector, round(r - avg(r) OVER (PARTITION BY d, sector), 6) AS relative,
      round(CAST(count(*) OVER () AS DOUBLE) / (count(*) OVER (PARTITION BY d)), 6) AS weight FROM k""",
)
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = returns(spark, sf_dir)
    total = x.agg(F.count(F.lit(1)).alias("total"))
    x = x.withColumn("p", P.pct_rank("r", ["d"]))
    x = x.select(
        "entity", "d", _r(F.coalesce(F.col("p") - 0.5, F.lit(0.0)), "centred"), _r(P.demean("p", ["d"]), "zero_mean"), _r(P.pct_rank("r", ["d", "sector"]), "in_sector"), _r(P.demean("r", ["d", "sector"]), "relative"), F.count(F.lit(1)).over(Window.partitionBy("d")).alias("per_day")
    )
    return x.join(F.broadcast(total)).withColumn("weight", F.round(F.col("total") / F.col("per_day"), 6)).drop("total", "per_day")


@query(
    "w22_w23_wealth",
    f"""WITH {RETURNS}, m AS (SELECT sector, d, avg(r) AS r FROM returns WHERE r IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT sector, d, exp(sum(ln(1 + r)) OVER (PARTITION BY sector ORDER BY d)) AS nav FROM m)
    SELECT sector, d, round(ln(nav), 6) AS log_nav, round(nav / greatest(1, max(nav) OVER (PARTITION BY sector ORDER BY d)) - 1, 6) AS dd FROM n""",
)
def wealth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.ordered("sector", "d")
    m = returns(spark, sf_dir).where("r is not null").groupBy("sector", "d").agg(F.avg("r").alias("r"))
    m = m.withColumn("nav", P.wealth("r", w))
    return m.select("sector", "d", _r(F.log("nav"), "log_nav"), _r(P.drawdown("nav", w), "dd"))


@query(
    "w24_w33_event_gap",
    """WITH g AS (SELECT user_id, event_id, ts, (epoch(ts) - epoch(lag(ts) OVER w)) / 86400.0 AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, round(gap, 6) AS gap FROM g WHERE back = 2""",
)
def event_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    w = P.ordered("user_id", ["ts", "event_id"])
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 86400e6
    e = e.withColumn("gap", gap).withColumn("at", F.struct("ts", "event_id"))
    return P.nth_last(e, 2, ["user_id"], "at").select("user_id", "event_id", _r(F.col("gap"), "gap"))


@query(
    "w25_novelty",
    """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
    j AS (SELECT a.vec_id, max(list_dot_product(a.e, b.e)) AS best FROM n a JOIN n b ON b.label = a.label AND b.i BETWEEN a.i - 20 AND a.i - 1 GROUP BY 1)
    SELECT vec_id, label, round(CASE WHEN best IS NOT NULL THEN greatest(0, least(1, 1 - best)) END, 6) AS novelty FROM n LEFT JOIN j USING (vec_id)""",
)
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", "label", _r(P.novelty("e", P.ordered("label", "vec_id")), "novelty"))


@query(
    "w26_first_report_change",
    """WITH f AS (SELECT user_id, event_type, CAST(ts AS DATE) AS period, arg_min(value, row(ts, event_id)) AS v FROM events GROUP BY 1, 2, 3),
    l AS (SELECT *, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY period) AS p FROM f)
    SELECT user_id, event_type, period, round(CASE WHEN p IS NOT NULL THEN greatest(-2, least(2, 2 * (v - p) / nullif(abs(v) + abs(p), 0))) END, 6) AS change FROM l""",
)
def first_report_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.functions.exprs import symmetric_change

    e = table(spark, sf_dir, "events")
    f = e.groupBy("user_id", "event_type", F.to_date("ts").alias("period")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("v"))
    w = P.ordered(["user_id", "event_type"], "period")
    return f.withColumn("p", F.lag("v").over(w)).select("user_id", "event_type", "period", _r(symmetric_change("v", "p"), "change"))


@query(
    "w28_w32_benchmark",
    f"""WITH {BARS}, m AS (SELECT d, avg(open) AS o, avg(close) AS c FROM bars GROUP BY d), b AS (SELECT d, CASE WHEN lag(c) OVER w IS NULL THEN c / o - 1 ELSE c / lag(c) OVER w - 1 END AS r FROM m WINDOW w AS (ORDER BY d))
    SELECT d, round(r, 6) AS r, round(CASE WHEN count(r) OVER f >= 30 THEN avg(r) OVER f END, 6) AS r63 FROM b WINDOW f AS (ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""",
)
def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row a period: the whole-table window is over the calendar, not the facts
    m = bars(spark, sf_dir).groupBy("d").agg(F.avg("open").alias("o"), F.avg("close").alias("c"))
    w = Window.orderBy("d")
    before = F.lag("c").over(w)
    m = m.withColumn("r", F.when(before.isNull(), F.col("c") / F.col("o") - 1).otherwise(F.col("c") / before - 1))
    return m.select("d", _r(F.col("r"), "r"), _r(P.rolling(F.avg, "r", 63, 30, w), "r63"))


@query(
    "w30_sequence_window",
    f"""WITH {RETURNS}, n AS (SELECT entity, d, r, row_number() OVER (PARTITION BY entity ORDER BY d) AS i FROM returns),
    s AS (SELECT a.entity, a.d, count(*) AS n, sum(b.r * b.i) AS dot FROM n a JOIN n b ON b.entity = a.entity AND b.i BETWEEN a.i - 30 AND a.i - 1 GROUP BY 1, 2)
    SELECT entity, d, round(dot, 6) AS dot FROM s WHERE n = 30""",
)
def sequence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = returns(spark, sf_dir).withColumn("i", F.row_number().over(_w()))
    x = x.withColumn("s", P.sequence_window(["i", "r"], _w(), 30)).where("s is not null")
    dot = F.aggregate("s", F.lit(0.0), lambda a, v: a + F.coalesce(v["r"] * v["i"], F.lit(0.0)))
    return x.select("entity", "d", _r(dot, "dot"))
