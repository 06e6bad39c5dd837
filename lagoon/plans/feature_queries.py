"""Queries of feature builders, evaluators and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.operators import evaluate as V
from lagoon.operators import features as N
from lagoon.operators import panel as P
from lagoon.plans.agg_queries import RANKED, SCORED, scored
from lagoon.plans.registry import query
from lagoon.plans.tables import BARS, OHLC, SECTORS, bars, ohlc, sectors, table


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _roll(agg: str, x: str, n: int, least: int) -> str:
    over = f"OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {agg}({x}) {over} END"


def _ema(x: str, span: int) -> str:
    return f"list_reduce({x}[1:i], lambda y, v: v * (2.0 / {span + 1}) + y * (1 - 2.0 / {span + 1}))"


#: Price features of each bar, without the exponential means.
QUANT_SQL = f"""{OHLC}, {SECTORS},
    p0 AS (SELECT b.*, sector, lag(close) OVER w AS c1, lag(close, 3) OVER w AS c3, lag(close, 5) OVER w AS c5, lag(close, 10) OVER w AS c10, lag(close, 21) OVER w AS c21, lag(close, 63) OVER w AS c63, lag(close, 126) OVER w AS c126, lag(close, 252) OVER w AS c252
           FROM bars b JOIN sectors s ON s.entity = b.entity WINDOW w AS (PARTITION BY b.entity ORDER BY d)),
    p1 AS (SELECT *, ln(close / c1) AS r1, ln(close / c5) AS r5, ln(close / c21) AS r21, close / c3 - 1 AS roc3, close / c10 - 1 AS roc10, (high - low) / close AS span, (open - c1) / (c1 + 1e-8) AS gap, greatest(close - c1, 0) + 0 * c1 AS up, greatest(c1 - close, 0) + 0 * c1 AS down, ln(1 + close * volume) AS dollars FROM p0),
    q AS (SELECT *, (volume - {_roll("avg", "volume", 20, 5)}) / ({_roll("stddev_samp", "volume", 20, 5)} + 1e-8) AS volume_z, (dollars - {_roll("avg", "dollars", 20, 5)}) / ({_roll("stddev_samp", "dollars", 20, 5)} + 1e-8) AS dollar_z,
          {_roll("stddev_samp", "r1", 20, 5)} AS vol20, {_roll("avg", "close", 20, 5)} / ({_roll("avg", "close", 200, 20)} + 1e-8) - 1 AS sma_ratio, (50 - 100 / (1 + {_roll("avg", "up", 14, 5)} / ({_roll("avg", "down", 14, 5)} + 1e-8))) / 50 AS rsi,
          {_roll("stddev_samp", "r1", 5, 3)} / ({_roll("stddev_samp", "r1", 60, 20)} + 1e-8) - 1 AS vol_regime, (isodow(d) - 1) / 4.0 - 0.5 AS weekday, CAST(day(d) = 1 AS DOUBLE) AS month_start, CAST(d = last_day(d) AS DOUBLE) AS month_end FROM p1)"""


@query(
    "x1_quant_features",
    f"""WITH {QUANT_SQL}, l AS (SELECT entity, list(d ORDER BY d) AS ds, list(close ORDER BY d) AS x FROM bars GROUP BY entity),
    e AS (SELECT entity, ds, x, [{_ema("x", 12)} - {_ema("x", 26)} FOR i IN range(1, len(x) + 1)] AS line FROM l), g AS (SELECT entity, ds, line, [{_ema("line", 9)} FOR i IN range(1, len(x) + 1)] AS sig FROM e),
    m AS (SELECT entity, unnest(ds) AS d, unnest(line) AS line, unnest(sig) AS sig FROM g)
    SELECT entity, d, round(r1, 6) AS r1, round(r5, 6) AS r5, round(r21, 6) AS r21, round(span, 6) AS span, round(gap, 6) AS gap, round(volume_z, 5) AS volume_z, round(vol20, 6) AS vol20, round(sma_ratio, 6) AS sma_ratio, round(rsi, 5) AS rsi, round((line - sig) / (close + 1e-8), 6) AS macd,
      round(roc3, 6) AS roc3, round(roc10, 6) AS roc10, round(vol_regime, 5) AS vol_regime, round(dollar_z, 5) AS dollar_z, weekday, month_start, month_end FROM q JOIN m USING (entity, d)""",
)
def quant(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = N.quant_features(ohlc(spark, sf_dir)).select("entity", "d", *N.QUANT)
    rough = ["volume_z", "rsi", "vol_regime", "dollar_z"]
    return _round(_round(x, *rough, digits=5), *[c for c in N.QUANT if c not in (*rough, "weekday", "month_start", "month_end")])


@query(
    "x2_cross_section",
    f"""WITH {QUANT_SQL} SELECT entity, d, sector, round(r1 - avg(r1) OVER (PARTITION BY d, sector), 6) AS sector_relative, round(CASE WHEN volume_z IS NOT NULL THEN (rank() OVER (PARTITION BY d ORDER BY volume_z NULLS LAST) + (count(*) OVER (PARTITION BY d, volume_z) - 1) / 2.0) / count(volume_z) OVER (PARTITION BY d) - 0.5 END, 6) AS volume_z_rank,
      round(CASE WHEN r5 IS NOT NULL THEN (rank() OVER (PARTITION BY d ORDER BY r5 NULLS LAST) + (count(*) OVER (PARTITION BY d, r5) - 1) / 2.0) / count(r5) OVER (PARTITION BY d) - 0.5 END, 6) AS r5_rank FROM q""",
)
def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.ordered("entity", "d")
    x = ohlc(spark, sf_dir).join(sectors(spark, sf_dir), "entity").select("entity", "d", "sector", P.log_return("close", 1, w).alias("r1"), P.log_return("close", 5, w).alias("r5"), P.zscore("volume", 20, 5, w).alias("volume_z"))
    return _round(N.cross_section(x, "d", "sector").drop("r1", "r5", "volume_z"), *N.CROSS)


#: A market: the mean open and close of all entities' bars.
MARKET = "market AS (SELECT d, avg(open) AS open, avg(close) AS close FROM bars GROUP BY d)"


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("d").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))


@query(
    "x3_training_frame",
    f"""WITH {QUANT_SQL}, {MARKET}, codes AS (SELECT sector, CAST(row_number() OVER (ORDER BY sector) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT sector FROM sectors)),
    mt AS (SELECT d, lead(close, 3) OVER (ORDER BY d) / open - 1 AS mr FROM market),
    t AS (SELECT entity, d, sector, code, lag(r5) OVER w AS a, lag(volume_z) OVER w AS b, lag(r5, 4) OVER w AS a4, lag(volume_z, 4) OVER w AS b4, lead(d, 3) OVER w AS e, lead(close, 3) OVER w / open - 1 AS raw FROM q JOIN codes USING (sector) WINDOW w AS (PARTITION BY entity ORDER BY d)),
    x AS (SELECT t.*, raw - mr AS alpha FROM t JOIN mt USING (d) WHERE raw - mr IS NOT NULL)
    SELECT entity, d, sector, round(a, 6) AS r5__lag1, round(b, 5) AS volume_z__lag1, round(a4, 6) AS r5__lag4, round(b4, 5) AS volume_z__lag4, code AS sector_code, e AS target_end, round(raw, 6) AS raw_target, round(alpha, 6) AS target_alpha, round({RANKED.format(g="d", x="alpha")} - 0.5, 6) AS target_rank FROM x""",
)
def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, names = N.training_frame(ohlc(spark, sf_dir), sectors(spark, sf_dir).drop("country"), market(spark, sf_dir), steps=(1, 4), horizon=4, features=["r5", "volume_z"])
    rough = [n for n in names if n.startswith("volume_z")]
    return _round(_round(x, *rough, digits=5), *[n for n in names if n.startswith("r5")], "raw_target", "target_alpha", "target_rank")


@query(
    "x4_extended_lags",
    f"""WITH {QUANT_SQL}, x AS (SELECT entity, d, sector, ln(close / c63) AS r63, ln(close / c126) AS r126, ln(close / c252) AS r252, {_roll("stddev_samp", "r1", 60, 20)} AS vol60, {_roll("stddev_samp", "r1", 252, 60)} AS vol252, {_roll("stddev_samp", "least(r1, 0) + 0 * r1", 60, 20)} AS downside60,
      close / {_roll("max", "close", 63, 20)} - 1 AS off_high63, close / {_roll("max", "close", 252, 60)} - 1 AS off_high252, {_roll("avg", "volume", 20, 5)} / ({_roll("avg", "volume", 60, 20)} + 1e-8) - 1 AS volume_ratio, {_roll("avg", "abs(r1) / (close * volume + 1e-8)", 20, 5)} AS illiquidity,
      (close - low) / (high - low + 1e-8) - 0.5 AS close_location, close / (open + 1e-8) - 1 AS body, r21 - avg(r21) OVER (PARTITION BY d, sector) AS sector_relative21 FROM q),
    y AS (SELECT *, r63 - avg(r63) OVER (PARTITION BY d, sector) AS sector_relative63 FROM x)
    SELECT entity, d, {", ".join(f"round(lag({c}, 5) OVER (PARTITION BY entity ORDER BY d), {9 if c == 'illiquidity' else 5}) AS {c}__lag5" for c in N.EXTENDED)} FROM y""",
)
def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.ordered("entity", "d")
    x = ohlc(spark, sf_dir).join(sectors(spark, sf_dir), "entity").withColumns({"r1": P.log_return("close", 1, w), "r21": P.log_return("close", 21, w)})
    x, names = N.extended_features(x, "sector", (5,))
    return x.select("entity", "d", *[F.round(n, 9 if n.startswith("illiquidity") else 5).alias(n) for n in names])


#: Assessments made of line items: a supplier's shipping day is a key.
ASSESSED = """asd AS (SELECT l_suppkey AS k, year(l_shipdate) AS y, (l_discount - 0.05) * 20 AS impact, CASE WHEN l_tax < 0.08 THEN l_tax * 10 ELSE 0.95 END AS conf, l_quantity / 50 AS nov, l_tax * 5 AS pers, l_orderkey AS art, l_returnflag AS dom, CAST(l_linenumber AS BIGINT) AS cnt FROM lineitem)"""


@query(
    "a10_assessment_features",
    f"""WITH {ASSESSED}, w AS (SELECT *, greatest(0.05, conf * abs(impact)) AS w FROM asd),
    m AS (SELECT k, y, CASE WHEN sum(conf) <> 0 THEN sum(impact * conf) / sum(conf) ELSE avg(impact) END AS mean FROM w GROUP BY 1, 2),
    s AS (SELECT w.k, w.y, any_value(mean) AS mean, CASE WHEN sum(conf) <> 0 THEN sum((impact - mean) ** 2 * conf) / sum(conf) ELSE avg((impact - mean) ** 2) END AS var FROM w JOIN m ON m.k = w.k AND m.y = w.y GROUP BY 1, 2)
    SELECT w.k, w.y, round(any_value(mean), 6) AS signed_impact, round(max(abs(impact)), 6) AS max_absolute_impact, round(1 - product(1 - conf), 6) AS confidence, round(sum(nov * w) / sum(w), 6) AS novelty, round(sum(pers * w) / sum(w), 6) AS persistence, round(sum(nov * w) / sum(w), 6) AS uncertainty_change,
      round(greatest(sum(pers * w) / sum(w), least(1, sqrt(greatest(any_value(var), 0)) + CASE WHEN max(impact) > 0.05 AND min(impact) < -0.05 THEN 0.25 ELSE 0 END)), 5) AS disagreement, CAST(count(DISTINCT art) AS BIGINT) AS article_count, CAST(count(*) AS BIGINT) AS event_count, CAST(count(DISTINCT dom) FILTER (dom <> 'A') AS BIGINT) AS source_count, round(sum(nov * w) / sum(w), 6) AS nov, CAST(sum(cnt) AS BIGINT) AS cnt
    FROM w JOIN s ON s.k = w.k AND s.y = w.y GROUP BY 1, 2""",
)
def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax, dom = F.col("l_tax"), F.col("l_returnflag")
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y"), ((F.col("l_discount") - 0.05) * 20).alias("impact"), F.when(tax < 0.08, tax * 10).otherwise(0.95).alias("confidence"),
        (F.col("l_quantity") / 50).alias("nov"), (tax * 5).alias("persistence"), F.array("l_orderkey").alias("articles"), F.array(F.when(dom != "A", dom), F.lit("")).alias("domains"), F.col("l_linenumber").cast("bigint").alias("cnt"),
    )
    made = N.assessment_features(x, ["k", "y"], N.Assessment(novelty="nov", uncertainty="nov", disagreement="persistence", averaged=("nov",), counted=("cnt",)))
    rough = ["signed_impact", "max_absolute_impact", "confidence", "novelty", "persistence", "uncertainty_change", "nov"]
    made = _round(made, "disagreement", *rough, digits=12)  # a tie but for the order of a sum is rounded up in any order
    return _round(_round(made, "disagreement", digits=5), *rough)


@query(
    "x6_transaction_windows",
    """WITH days AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem), INTERVAL 1 DAY)) AS DATE) AS d), keys AS (SELECT DISTINCT s_nationkey AS k FROM supplier),
    t AS (SELECT s_nationkey AS k, CAST(l_shipdate AS DATE) AS d, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS bv, count(*) FILTER (l_returnflag = 'R') AS bc, count(*) FILTER (l_returnflag = 'R' AND l_tax > 0.05) AS bp, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS sv, count(*) FILTER (l_returnflag = 'N') AS sc, count(*) FILTER (l_returnflag = 'N' AND l_tax > 0.05) AS sp FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    g AS (SELECT k, d, coalesce(bv, 0) AS bv, coalesce(bc, 0) AS bc, coalesce(bp, 0) AS bp, coalesce(sv, 0) AS sv, coalesce(sc, 0) AS sc, coalesce(sp, 0) AS sp, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM keys CROSS JOIN days LEFT JOIN t USING (k, d))
    SELECT k, d, round(ln(1 + sum(bv) OVER w), 6) AS w5_purchase_log, round(ln(1 + sum(sv) OVER w), 6) AS w5_sale_log, round(ln(1 + sum(bv) OVER w) - ln(1 + sum(sv) OVER w), 6) AS w5_net_log, CAST(sum(bc) OVER w AS DOUBLE) AS w5_purchase_count, CAST(sum(sc) OVER w AS DOUBLE) AS w5_sale_count,
      round(coalesce(sum(bp) OVER w / nullif(sum(bc) OVER w, 0), 0), 6) AS w5_planned_purchase_share, round(coalesce(sum(sp) OVER w / nullif(sum(sc) OVER w, 0), 0), 6) AS w5_planned_sale_share, CAST(least(252, coalesce(i - max(CASE WHEN bc > 0 THEN i END) OVER a, 252)) AS INTEGER) AS since_purchase, CAST(least(252, coalesce(i - max(CASE WHEN sc > 0 THEN i END) OVER a, 252)) AS INTEGER) AS since_sale
    FROM g WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), a AS (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagoon.operators.calendar import span_of

    is_, planned = (lambda f: F.col("l_returnflag") == f), F.col("l_tax") > 0.05
    value = lambda c: F.sum(F.when(c, F.col("l_extendedprice")).otherwise(0.0))
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sides = [(is_("R"), "purchase"), (is_("N"), "sale")]
    daily = li.groupBy(F.col("s_nationkey").alias("k"), F.to_date("l_shipdate").alias("d")).agg(*[e for c, s in sides for e in (value(c).alias(f"{s}_value"), F.count_if(c).alias(f"{s}_count"), F.count_if(c & planned).alias(f"planned_{s}_count"))])
    days = span_of(table(spark, sf_dir, "lineitem"), "l_shipdate", "d")
    keys = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    dense = keys.join(F.broadcast(days)).join(daily, ["k", "d"], "left")  # the result itself: every key on every session
    made = N.transaction_features(dense, "k", "d", ["purchase_count", "sale_count"], (5,))
    return _round(made, *[c for c in made.columns if c.endswith(("_log", "_share"))])


DAILY = f"""WITH {SCORED}, one AS (SELECT entity, sector, d, score, target, volume, count(*) OVER (PARTITION BY d) AS n FROM scored)"""


def _daily_sql(rows: str, x: str, name: str) -> str:
    """Daily ic and spread of prediction x over the rows of one relation."""
    return f"""{name}_k AS (SELECT d, target, {RANKED.format(g="d", x=x)} AS p, {RANKED.format(g="d", x="target")} AS t, count(*) OVER (PARTITION BY d) AS n, row_number() OVER (PARTITION BY d ORDER BY {x} DESC, entity DESC) AS up, row_number() OVER (PARTITION BY d ORDER BY {x}, entity) AS down FROM {rows}),
    {name} AS (SELECT d, count(*) AS names, CASE WHEN count(*) >= 3 AND stddev_pop(p) > 0 AND stddev_pop(t) > 0 THEN corr(p, t) END AS ic, avg(target) FILTER (n >= 20 AND up <= greatest(1, n // 10)) - avg(target) FILTER (n >= 20 AND down <= greatest(1, n // 10)) AS spread FROM {name}_k GROUP BY d)"""


@query(
    "x8_prediction_scores",
    f"""WITH {SCORED}, {_daily_sql("scored", "score", "s")}
    SELECT rows, half_accuracy, rmse, prediction_std, round(mean_ic, 6) AS mean_ic, round(ic_std, 6) AS ic_std, round(mean_ic / ic_std, 5) AS icir, ic_days, round(mean_spread, 6) AS mean_spread
    FROM (SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(CAST(sign(score) = sign(target) AS DOUBLE)), 6) AS half_accuracy, round(sqrt(avg((score - target) ** 2)), 6) AS rmse, round(stddev_pop(score), 6) AS prediction_std FROM scored), (SELECT avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, CAST(count(ic) AS BIGINT) AS ic_days, avg(spread) AS mean_spread FROM s)""",
)
def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.prediction_scores(scored(spark, sf_dir), "d", "score", "target", "entity")
    return _round(_round(x, "icir", digits=5), "half_accuracy", "rmse", "prediction_std", "mean_ic", "ic_std", "mean_spread")


@query(
    "x9_paired_comparison",
    f"""WITH {SCORED}, base AS (SELECT *, score + volume / 1000 AS other, volume > 60 AS onn FROM scored), {_daily_sql("base", "score", "a")}, {_daily_sql("base", "other", "b")}, {_daily_sql("(SELECT * FROM base WHERE onn)", "score", "c")}, {_daily_sql("(SELECT * FROM base WHERE onn)", "other", "e")}, n AS (SELECT d, CAST(count(*) FILTER (onn) AS BIGINT) AS active_rows FROM base GROUP BY d),
    j AS (SELECT n.d, active_rows, CAST(a.names AS BIGINT) AS names, CASE WHEN b.ic IS NOT NULL THEN a.ic END AS fi, CASE WHEN a.ic IS NOT NULL THEN b.ic END AS si, a.spread AS fs, b.spread AS ss, CASE WHEN e.ic IS NOT NULL THEN c.ic END AS afi, CASE WHEN c.ic IS NOT NULL THEN e.ic END AS asi FROM n JOIN a USING (d) JOIN b USING (d) LEFT JOIN c USING (d) LEFT JOIN e USING (d))
    SELECT d, active_rows, names, round(fi, 6) AS first_ic, round(si, 6) AS second_ic, round(fs, 6) AS first_spread, round(ss, 6) AS second_spread, round(afi, 6) AS active_first_ic, round(asi, 6) AS active_second_ic, round(si - fi, 6) AS ic_lift, round(ss - fs, 6) AS spread_lift, round(asi - afi, 6) AS active_ic_lift FROM j""",
)
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.paired_comparison(scored(spark, sf_dir).withColumn("other", F.col("score") + F.col("volume") / 1000), "d", "score", "other", "target", "entity", F.col("volume") > 60)
    return _round(x, "first_ic", "second_ic", "first_spread", "second_spread", "active_first_ic", "active_second_ic", "ic_lift", "spread_lift", "active_ic_lift")


@query(
    "x11_short_side",
    f"""WITH {SCORED}, base AS (SELECT *, score + volume / 1000 AS other, target - avg(target) OVER (PARTITION BY d) AS alpha, greatest(1, count(*) OVER (PARTITION BY d) // 10) AS n FROM scored),
    k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score, entity) <= n AS a, row_number() OVER (PARTITION BY d ORDER BY other, entity) <= n AS b FROM base), m AS (SELECT 'score' AS model, * FROM k WHERE a UNION ALL SELECT 'other', * FROM k WHERE b)
    SELECT d, model, CAST(count(*) AS BIGINT) AS names, round(-avg(target), 6) AS short_return, round(-avg(alpha), 6) AS short_alpha, round(avg(CAST(target < 0 AS DOUBLE)), 6) AS declined, round(avg(CAST(alpha < 0 AS DOUBLE)), 6) AS underperformed, round(avg(CAST(a AS DOUBLE)), 6) AS overlap FROM m GROUP BY 1, 2""",
)
def shorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scored(spark, sf_dir).withColumns({"other": F.col("score") + F.col("volume") / 1000, "alpha": P.demean("target", ["d"])})
    return _round(V.short_side(x, "d", "entity", ["score", "other"], "score", "target", "alpha"), "short_return", "short_alpha", "declined", "underperformed", "overlap")


GATE_SQL = f"""WITH {SCORED}, {_daily_sql("scored", "score", "s")}, dd AS (SELECT d, stddev_pop(score) AS disp, row_number() OVER (ORDER BY d) AS i FROM scored GROUP BY d), x AS (SELECT dd.*, coalesce(spread, 0) AS spread FROM dd JOIN s USING (d)),
    h AS (SELECT a.d, count(*) AS n, count(*) FILTER (b.disp <= a.disp) AS k FROM x a JOIN x b ON b.i BETWEEN a.i - 104 AND a.i - 1 GROUP BY a.d), y AS (SELECT x.d, disp, spread, CASE WHEN n >= 26 THEN k / n END AS pc FROM x LEFT JOIN h USING (d)),
    g AS (SELECT t AS threshold, avg(CASE WHEN pc >= t THEN 1.0 ELSE 0 END) AS trade_share, avg(CASE WHEN pc >= t THEN spread ELSE 0 END) AS gross, avg(CASE WHEN pc >= t THEN spread - 0.004 ELSE 0 END) AS net FROM y, (SELECT unnest([0.0, 0.25, 0.5, 0.75]) AS t) WHERE year(d) IN (1995, 1996) GROUP BY 1),
    z AS (SELECT *, net >= max(net) OVER () - 0.00005 AS good FROM g), c AS (SELECT *, good AND threshold = min(CASE WHEN good THEN threshold END) OVER () AS chosen FROM z)"""


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = scored(spark, sf_dir)
    daily = V.daily_scores(x, "d", "score", "target", "entity").join(x.groupBy("d").agg(F.stddev_pop("score").alias("dispersion")), "d").na.fill(0.0, ["spread"]).select("d", "dispersion", "spread")
    return V.dispersion_gate(daily, "d", "dispersion", "spread", (1995, 1996), (0.0, 0.25, 0.5, 0.75), 10.0, 0.5, 104, 26)


@query("x12_gate_thresholds", GATE_SQL + " SELECT CAST(threshold AS DOUBLE) AS threshold, round(trade_share, 6) AS trade_share, round(gross, 6) AS gross, round(net, 6) AS net, chosen FROM c")
def gate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_gate(spark, sf_dir)[1], "trade_share", "gross", "net")


@query("x12_gate_days", GATE_SQL + " SELECT d, round(disp, 6) AS dispersion, round(spread, 6) AS spread, round(pc, 6) AS percentile, CAST(coalesce(pc >= threshold, FALSE) AS INTEGER) AS trade, round(CASE WHEN pc >= threshold THEN spread ELSE 0 END, 6) AS gross, round(CASE WHEN pc >= threshold THEN spread - 0.004 ELSE 0 END, 6) AS net FROM y, (SELECT threshold FROM c WHERE chosen)")
def gate_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_gate(spark, sf_dir)[0], "dispersion", "spread", "percentile", "gross", "net")


@query(
    "x15_event_summary",
    f"""WITH {SCORED}, sp AS (SELECT * FROM (VALUES ('all', DATE '1992-01-01', DATE '2099-12-31'), ('late', DATE '1996-01-01', DATE '1998-12-31'), ('none', DATE '2050-01-01', DATE '2050-12-31')) AS v(name, a, b)), h AS (SELECT name, score, target FROM scored JOIN sp ON d BETWEEN a AND b),
    k AS (SELECT *, {RANKED.format(g="name", x="score")} AS p, {RANKED.format(g="name", x="target")} AS t FROM h)
    SELECT name, CAST(count(*) AS BIGINT) AS events, round(corr(p, t), 6) AS ic, round(avg(CAST(sign(score) = sign(target) AS DOUBLE)) FILTER (score <> 0 AND target <> 0), 6) AS sign_accuracy, round(avg(score), 6) AS mean_predicted, round(avg(target), 6) AS mean_realised FROM k GROUP BY 1""",
)
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = spark.sql("SELECT * FROM VALUES ('all', DATE '1992-01-01', DATE '2099-12-31'), ('late', DATE '1996-01-01', DATE '1998-12-31'), ('none', DATE '2050-01-01', DATE '2050-12-31') AS v(name, first, last)")
    return _round(V.event_summary(scored(spark, sf_dir), splits, "d", "score", "target"), "ic", "sign_accuracy", "mean_predicted", "mean_realised")


@query(
    "j10_raw_returns",
    f"""WITH {BARS}, x AS (SELECT entity, d, lead(d, 3) OVER (PARTITION BY entity ORDER BY d) AS until FROM bars) SELECT x.entity, x.d, until, a.open AS entry_open, b.close AS exit_close, round(b.close / a.open - 1, 6) AS raw_target FROM x LEFT JOIN bars a ON a.entity = x.entity AND a.d = x.d LEFT JOIN bars b ON b.entity = x.entity AND b.d = until""",
)
def raw_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return _round(V.with_raw_returns(b.select("entity", "d", F.lead("d", 3).over(P.ordered("entity", "d")).alias("until")), b, "entity", "d", "until"), "raw_target")


@query(
    "p13_p14_p17_blends",
    f"""WITH {SCORED}, k AS (SELECT entity, d, score, target, volume, {RANKED.format(g="d, sector", x="volume")} AS sp, {RANKED.format(g="d", x="volume")} AS rv, {RANKED.format(g="d", x="score")} AS rs FROM scored)
    SELECT entity, d, round(rs - 0.5, 6) AS overall_rank, round(sp - 0.5, 6) AS specialist_rank, round(rs - 0.5 + 0.75 * (sp - 0.5), 7) AS blend, round((rv + rs) / 2, 6) AS risk, round(CASE WHEN volume - 50 > 0 THEN score + 0.5 * target ELSE score END, 6) AS corrected, greatest(0, least(1, round(score, 6))) AS share, greatest(-1, least(1, round(target, 6))) AS signed, greatest(0, round_even(volume / 10, 0)) AS counted FROM k""",
)
def blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = N.blended(scored(spark, sf_dir).withColumn("spare", F.col("volume") - 50), "d", "sector", "score", "volume", 0.75)
    x = x.withColumns({"risk": N.mean_rank(["volume", "score"], ["d"]), "corrected": N.gated("score", "target", N.active(["spare"]), 0.5), "share": F.round("score", 6), "signed": F.round("target", 6), "counted": F.col("volume") / 10})
    x = N.bounded(x, ["share"], ["signed"], ["counted"])
    return _round(_round(x.select("entity", "d", "overall_rank", "specialist_rank", "blend", "risk", "corrected", "share", "signed", "counted"), "blend", digits=7), "overall_rank", "specialist_rank", "risk", "corrected")


@query(
    "p2_p5_p15_columns",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 0.001, 6) AS l_extendedprice, l_quantity * 2 AS l_quantity, l_discount, l_tax FROM (SELECT *, CASE WHEN l_discount > 0 THEN 1 ELSE 0 END + CASE WHEN l_tax > 0 THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS n FROM lineitem) WHERE n >= 2""",
)
def column_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    doubles = N.select_columns(li, ["double"], "l_")
    some = li.withColumns({"__a": F.when(F.col("l_discount") > 0, 1), "__b": F.when(F.col("l_tax") > 0, 1), "__c": F.when(F.col("l_returnflag") == "R", 1)})
    kept = N.least_filled(some, ["__a", "__b", "__c"], 2).select("l_orderkey", "l_linenumber", "l_partkey", *doubles)
    return _round(N.scaled(kept, {"money": (["l_extendedprice"], 0.001), "size": (["l_quantity", "l_extendedprice"], 2.0)}), "l_extendedprice")


@query("p19_coverage_gate", "SELECT CAST(count(*) AS BIGINT) AS rows FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    universe = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return N.coverage_gate(o, universe, "o_custkey").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "p20_text_vector",
    r"""WITH t AS (SELECT doc_id, text, n_chars, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS w FROM documents)
    SELECT doc_id, round(ln(1 + w), 6) AS x0, round(ln(1 + coalesce(n_chars, 0)), 6) AS x1, round(coalesce(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) / nullif(w, 0), 0), 6) AS x2, CAST(coalesce(text, '') LIKE '%license%' AS DOUBLE) AS x3 FROM t""",
)
def text_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+"))
    v = N.text_vector(words, [F.regexp_count(text, F.lit("[0-9]+"))], [words, F.col("n_chars")], [text.contains("license")])
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).select("doc_id", *[F.round(F.col("v")[i], 6).alias(f"x{j}") for i, j in ((0, 0), (1, 1), (2, 2), (3, 3))])


PRICED = {"A": {"hit": 0.5, "miss": 2.0, "made": 8.0}, "R": {"hit": 0.1, "miss": 1.0, "made": 4.0}}


@query(
    "a33_cost_sums",
    """SELECT l_linestatus, CAST(sum(l_orderkey) AS BIGINT) AS hit, CAST(sum(l_partkey) AS BIGINT) AS miss, CAST(sum(l_suppkey) AS BIGINT) AS made, round(sum(CASE l_returnflag WHEN 'A' THEN 0.5 * l_orderkey + 2 * l_partkey + 8 * l_suppkey WHEN 'R' THEN 0.1 * l_orderkey + l_partkey + 4 * l_suppkey ELSE 0 END) / 1e6, 4) AS cost FROM lineitem GROUP BY 1""",
)
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("hit"), F.col("l_partkey").alias("miss"), F.col("l_suppkey").alias("made"))
    return _round(N.cost_sums(u, PRICED, ["l_linestatus"]), "cost", digits=4)


@query(
    "w33_kth_last",
    f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS n, max(d) OVER (PARTITION BY entity) AS last, max(d) OVER () AS every FROM bars) SELECT entity, CASE WHEN n = 3 THEN d ELSE last END AS d, n = 3 AS picked FROM k WHERE n = 3 OR (n = 1 AND last < every)""",
)
def kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stale = V.kth_last(bars(spark, sf_dir), "entity", "d", 3)
    return rows.select("entity", "d", F.lit(True).alias("picked")).unionByName(stale.select("entity", F.col("last").alias("d"), F.lit(False).alias("picked")))


@query(
    "w31_day_weights",
    f"""WITH {SCORED} SELECT entity, d, round(count(*) OVER () / ((SELECT count(DISTINCT d) FROM scored) * count(*) OVER (PARTITION BY d)), 6) AS weight FROM scored""",
)
def day_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scored(spark, sf_dir).select("entity", "d")
    per_day = x.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    total = per_day.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("days"))
    return x.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("d"))).join(F.broadcast(total)).select("entity", "d", F.round(F.col("rows") / (F.col("days") * F.col("n")), 6).alias("weight"))


