"""Queries of the feature builders: fundamentals, macro releases, news surprises, backtests, cross-fits, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.functions import exprs as X
from lagoon.operators import fundamentals as D
from lagoon.operators import macro as C
from lagoon.operators import models as M
from lagoon.operators import portfolio as B
from lagoon.operators import select as S
from lagoon.operators.aliases import registrant_aliases
from lagoon.operators.calendar import day_range
from lagoon.operators.panel import ordered
from lagoon.plans.agg_queries import SCORED, scored
from lagoon.plans.registry import query
from lagoon.plans.tables import RETURNS, bars, returns, table

TAGS = [(m, kind, tag, unit, i) for m, unit, kind, tags in D.METRICS for i, tag in enumerate(tags)]


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(facts, filings): a supplier's line items of a quarter as the facts of one filing."""
    li = table(spark, sf_dir, "lineitem")
    quarter = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    accession = F.col("l_suppkey") * 1000 + F.year(quarter) % 100 * 4 + F.quarter(quarter)
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(u).alias("unit")) for _, _, t, u, _ in TAGS])
    x = li.withColumns({"accession": accession, "q": quarter, "n": (F.col("l_partkey") * 3 + F.col("l_linenumber") * 5 + F.col("l_orderkey")) % len(TAGS)}).withColumn("t", F.get(tags, F.col("n").cast("int")))
    end = F.date_add("q", (89 - F.col("l_partkey") % 60).cast("int"))
    begin = F.when(F.col("l_linenumber") > 2, F.date_sub(end, F.when(F.col("l_orderkey") % 3 == 0, 365).when(F.col("l_orderkey") % 3 == 1, 91).otherwise((60 + F.col("l_orderkey") % 200)).cast("int")))
    facts = x.select("accession", "t.tag", "t.unit", begin.alias("period_start"), end.alias("period_end"), F.col("l_extendedprice").alias("value"), F.year("q").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("q").cast("string")).alias("fiscal_period"), F.col("l_shipdate").alias("available_at"))
    cik = F.col("l_suppkey")
    form = F.when(F.quarter("q") == 4, "10-K").otherwise("10-Q")
    filings = x.select("accession", cik.alias("cik"), "q").distinct().select("accession", "cik", form.alias("form"), F.date_add("q", 89).alias("report_date"), F.to_timestamp(F.date_add("q", 120)).alias("accepted_at"), F.lit("accepted").alias("available_at_quality"))
    return facts, filings


def _fundamental_sql() -> str:
    share = lambda x, to, low, high: f"CASE WHEN {to} <> 0 AND {x} IS NOT NULL THEN greatest({low}, least({high}, ({x}) / abs({to}))) END"
    yearly, cash = "CASE WHEN form = '10-K' THEN 1.0 ELSE 4.0 END", "365.0 / CASE WHEN days IS NOT NULL THEN least(430.0, greatest(60.0, days)) END"
    scaled = {None: "{x}", "income": f"({{x}} * {yearly})", "cash": f"({{x}} * {cash})"}
    feature = {s.name: share(scaled[s.scale].format(x=f"f_{s.of}"), f"f_{s.to}", s.low, s.high) for s in D.SHARES}
    feature["debt_to_assets"] = share("(coalesce(f_long_term_debt, 0) + coalesce(f_current_debt, 0))", "f_assets", 0.0, 3.0)
    feature["accruals_to_assets"] = share(f"(f_net_income * {yearly} - f_operating_cash_flow * {cash})", "f_assets", -5.0, 5.0)
    for m in D.GROWTH:
        feature[f"{m}_yoy_change"] = f"CASE WHEN abs({m}) + abs(prior_{m}) <> 0 THEN greatest(-2.0, least(2.0, 2 * ({m} - prior_{m}) / (abs({m}) + abs(prior_{m})))) END"
    feature["fundamental_field_coverage"] = "(" + " + ".join(f"CASE WHEN f_{m} IS NOT NULL THEN 1 ELSE 0 END" for m in D.NAMES) + f") / {len(D.NAMES)}.0"
    feature["filing_is_annual"] = "CASE WHEN form = '10-K' THEN 1.0 ELSE 0.0 END"
    first = lambda c: "coalesce(" + ", ".join(f"max({c}) FILTER (metric = '{m}')" for m in D.PERIOD_FROM) + ")"
    return f"""WITH tags AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{m}', '{kind}', '{t}', {i})" for n, (m, kind, t, _, i) in enumerate(TAGS))}) v(n, metric, kind, tag, pref)),
    x AS (SELECT *, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, l_suppkey * 1000 + year(l_shipdate) % 100 * 4 + quarter(l_shipdate) AS accession, (l_partkey * 3 + l_linenumber * 5 + l_orderkey) % {len(TAGS)} AS n FROM lineitem),
    y AS (SELECT accession, q, metric, kind, tag, pref, l_extendedprice AS v, l_shipdate AS known, q + CAST(89 - l_partkey % 60 AS INTEGER) AS e, CASE WHEN l_linenumber > 2 THEN CASE l_orderkey % 3 WHEN 0 THEN 365 WHEN 1 THEN 91 ELSE 60 + l_orderkey % 200 END END AS len FROM x JOIN tags USING (n)),
    s AS (SELECT *, abs(e - (q + 89)) * 10000 + pref + 10 * CASE WHEN kind = 'instant' THEN CASE WHEN len IS NULL THEN 0 ELSE 500 END WHEN kind = 'income' THEN abs(len - CASE WHEN quarter(q) = 4 THEN 365 ELSE 91 END) ELSE abs(len - CASE quarter(q) WHEN 1 THEN 91 WHEN 2 THEN 182 WHEN 3 THEN 273 ELSE 365 END) END AS score
      FROM y WHERE abs(e - (q + 89)) <= 45 AND (kind = 'instant' OR len BETWEEN 45 AND 430)),
    b AS (SELECT accession, metric, arg_min(struct_pack(v := v, len := len, e := e, q := q), row(score, known, tag, e, coalesce(len, -1), v)) AS p FROM s GROUP BY 1, 2),
    fl AS (SELECT DISTINCT accession, l_suppkey AS cik, q, CASE WHEN quarter(q) = 4 THEN '10-K' ELSE '10-Q' END AS form FROM x),
    w AS (SELECT accession, {", ".join(f"max(p.v) FILTER (metric = '{m}') AS {m}" for m in D.NAMES)}, {first("p.e")} AS period_end, {first("'Q' || quarter(p.q)")} AS fp, {first("year(p.q)")} AS fiscal_year, coalesce(max(p.len) FILTER (metric = 'operating_cash_flow'), max(p.len) FILTER (metric = 'capital_expenditure')) AS days FROM b GROUP BY 1),
    e AS (SELECT fl.*, w.* EXCLUDE (accession, fp), coalesce(fp, CASE WHEN form = '10-K' THEN 'FY' END) AS fiscal_period FROM fl LEFT JOIN w USING (accession)),
    {", ".join(f"r_{m} AS (SELECT cik, fiscal_period, period_end, lag({m}) OVER (PARTITION BY cik, fiscal_period ORDER BY period_end) AS prior_{m} FROM (SELECT cik, fiscal_period, period_end, arg_min({m}, q) AS {m} FROM e WHERE {m} IS NOT NULL AND period_end IS NOT NULL AND fiscal_period IS NOT NULL GROUP BY 1, 2, 3))" for m in D.GROWTH)},
    g AS (SELECT e.*, {", ".join(f"prior_{m}" for m in D.GROWTH)}, {", ".join(f"last_value({m} IGNORE NULLS) OVER w AS f_{m}" for m in D.NAMES)} FROM e {" ".join(f"LEFT JOIN r_{m} USING (cik, fiscal_period, period_end)" for m in D.GROWTH)} WINDOW w AS (PARTITION BY cik ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    o AS (SELECT accession, cik, form, q, period_end, fiscal_period, CAST(fiscal_year AS INTEGER) AS fiscal_year, {", ".join(f"{sql} AS {name}" for name, sql in feature.items())} FROM g)
    SELECT s_name AS ticker, accession, form, CAST(period_end AS DATE) AS period_end, fiscal_period, CAST(fiscal_year AS DOUBLE) AS fiscal_year, (SELECT min(day) FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) WHERE day > q + 119) AS trade_date, {", ".join(f"round({c}, 6) AS {c}" for c in D.FEATURES)}
    FROM o JOIN supplier ON s_suppkey = cik WHERE (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) > q + 119 AND {" + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in D.FEATURES)} >= 5 QUALIFY row_number() OVER (PARTITION BY s_name, trade_date ORDER BY q DESC) = 1"""


@query("x5_fundamentals", _fundamental_sql())
def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, filings = reported(spark, sf_dir)
    sessions = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    who = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cik"), F.col("s_name").alias("ticker"))
    out = D.filing_snapshots(D.fundamental_features(D.chosen_facts(facts, filings)), who, sessions, "day", 5)
    return _round(out, *D.FEATURES).select("ticker", "accession", "form", "period_end", "fiscal_period", F.col("fiscal_year").cast("double"), "trade_date", *D.FEATURES)


ZSCORE = "CASE WHEN (CASE WHEN count({x}) OVER {p} >= {k} THEN stddev_samp({x}) OVER {p} WHEN count({x}) OVER {a} >= {k} THEN stddev_samp({x}) OVER {a} END) > 0 THEN greatest(-5, least(5, ({x} - CASE WHEN count({x}) OVER {p} >= {k} THEN avg({x}) OVER {p} ELSE avg({x}) OVER {a} END) / (CASE WHEN count({x}) OVER {p} >= {k} THEN stddev_samp({x}) OVER {p} ELSE stddev_samp({x}) OVER {a} END))) END"


def _z(x: str, k: int) -> str:
    return ZSCORE.format(x=x, k=k, p="p", a="a")


RELEASES = f"""v AS (SELECT l_returnflag AS s, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS o, CAST(date_trunc('month', l_shipdate) AS DATE) + CAST(31 + 61 * (l_orderkey % 3) AS INTEGER) AS t, max(l_quantity) + sum(l_linenumber) AS v FROM lineitem GROUP BY 1, 2, 3),
    rev AS (SELECT s, t, coalesce(avg(step), 0) AS revision_delta FROM (SELECT s, t, v - lag(v) OVER (PARTITION BY s, o ORDER BY t) AS step FROM v) GROUP BY 1, 2),
    k AS (SELECT r.s, r.t, v.o, arg_max(v.v, v.t) AS v FROM rev r JOIN v ON v.s = r.s AND v.t <= r.t GROUP BY 1, 2, 3),
    lv AS (SELECT s, t, max(o) AS latest, arg_max(v, o) AS level, arg_max(v, o) - list(v ORDER BY o DESC)[2] AS period_change FROM k GROUP BY 1, 2),
    e0 AS (SELECT lv.*, revision_delta, level - lag(level) OVER (PARTITION BY lv.s ORDER BY lv.t) AS release_delta FROM lv JOIN rev ON rev.s = lv.s AND rev.t = lv.t),
    e AS (SELECT *, {_z("level", 4)} AS regime_z, greatest(-5, least(5, coalesce({_z("release_delta", 4)}, {_z("period_change", 4)}, 0) + 0.25 * coalesce({_z("revision_delta", 4)}, 0))) AS impulse_z FROM e0
      WINDOW p AS (PARTITION BY s ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("s"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("o"), F.date_add(month, (31 + 61 * (F.col("l_orderkey") % 3)).cast("int")).alias("t"), "l_quantity", "l_linenumber")
    v = li.groupBy("s", "o", "t").agg((F.max("l_quantity") + F.sum("l_linenumber")).alias("v"))
    return C.release_events(v, "s", "o", "t", "v", 12, 4)


@query("i6_release_events", f"WITH {RELEASES} SELECT s, t, latest, level, round(period_change, 6) AS period_change, round(release_delta, 6) AS release_delta, round(revision_delta, 6) AS revision_delta, round(regime_z, 6) AS regime_z, round(impulse_z, 6) AS impulse_z FROM e")
def release_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(releases(spark, sf_dir), "period_change", "release_delta", "revision_delta", "regime_z", "impulse_z")


@query(
    "x32_macro_features",
    f"""WITH {RELEASES}, day AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)),
    pl AS (SELECT e.*, (SELECT min(d) FROM day WHERE d > t) AS d FROM e), la AS (SELECT s, d, arg_max(coalesce(regime_z, -99), t) AS rz, arg_max(impulse_z, t) AS iz FROM pl WHERE d IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT day.d, day.i, n.s, nullif(rz, -99) AS rz, iz, CASE WHEN iz IS NOT NULL THEN i END AS place FROM day CROSS JOIN (SELECT DISTINCT s FROM la) n LEFT JOIN la ON la.s = n.s AND la.d = day.d),
    f AS (SELECT d, s, coalesce(last_value(rz IGNORE NULLS) OVER w, 0) AS rz, coalesce(last_value(iz IGNORE NULLS) OVER w, 0) * exp(-coalesce(i - last_value(place IGNORE NULLS) OVER w, 0) / 20.0) AS iz FROM g WINDOW w AS (PARTITION BY s ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT d AS trade_date, {", ".join(f"round(max(rz) FILTER (s = '{s}'), 6) AS macro__{s.lower()}__regime_z, round(max(iz) FILTER (s = '{s}'), 6) AS macro__{s.lower()}__impulse_z" for s in "ANR")} FROM f GROUP BY 1""",
)
def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    out = C.macro_columns(C.macro_features(releases(spark, sf_dir), "s", "t", sessions, "day"), "s", ["A", "N", "R"])
    return _round(out, *[c for c in out.columns if c != "trade_date"])


GEO = ["purchase", "view", "error"]
GEO_RAW = ["event_count_total", "goldstein_mean", "goldstein_sum", "sentiment_mean", "media_volume_log", *[f"event_count__{c}" for c in GEO]]


@query(
    "x31_news_surprise",
    f"""WITH days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY)) AS DATE) AS d), ss AS (SELECT d FROM days WHERE dayofweek(d) NOT IN (0, 6)),
    x AS (SELECT (SELECT min(d) FROM ss WHERE d > CAST(ts AS DATE)) AS d, event_type, value AS impact, CASE WHEN event_type <> 'view' THEN user_id / 10.0 END AS tone, value - 50 AS vol FROM events WHERE event_type IS NOT NULL),
    r AS (SELECT d, count(*) AS event_count_total, avg(impact) AS goldstein_mean, sum(impact) AS goldstein_sum, avg(tone) AS sentiment_mean, ln(1 + coalesce(sum(greatest(vol, 0)), 0)) AS media_volume_log, {", ".join(f"count(*) FILTER (event_type = '{c}') AS event_count__{c}" for c in GEO)} FROM x WHERE d IS NOT NULL GROUP BY 1),
    f AS (SELECT ss.d, {", ".join(f"ln(1 + coalesce({c}, 0)) AS {c}" if "count" in c else f"CASE WHEN r.d IS NULL THEN 0 ELSE {c} END AS {c}" for c in GEO_RAW)} FROM ss LEFT JOIN r ON r.d = ss.d)
    SELECT d AS trade_date, {", ".join(f"round(coalesce({_z(c, 5)}, 0), 5) AS context__geo__{c}__surprise" for c in GEO_RAW)} FROM f WINDOW p AS (ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), a AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def news_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), "event_type", "value", F.when(F.col("event_type") != "view", F.col("user_id") / 10.0).alias("tone"), (F.col("value") - 50).alias("vol"))
    sessions = day_range(spark, "2024-01-01", "2024-02-15", "day").where("dayofweek(day) not in (1, 7)")
    out = C.news_surprise(e, "d", "event_type", GEO, "value", "tone", "vol", sessions, "day", 10, 5)
    return _round(out, *[c for c in out.columns if c != "trade_date"], digits=5)


def _backtest_sql(mode: str) -> str:
    long, short = ("1.0", "NULL") if mode == "long-only" else ("0.5", "-0.5")
    return f"""WITH RECURSIVE {SCORED}, pd AS (SELECT entity, d, score, lead(d, 3) OVER (PARTITION BY entity ORDER BY d) AS until FROM scored), pr AS (SELECT * FROM pd WHERE until IS NOT NULL),
    ss AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM bars WHERE d BETWEEN (SELECT min(d) FROM pr) AND (SELECT max(until) FROM pr))),
    rk AS (SELECT pr.*, b.open, ss.i AS c0, sx.i AS due, count(*) OVER (PARTITION BY pr.d) AS n, row_number() OVER (PARTITION BY pr.d ORDER BY score, pr.entity) AS p FROM pr JOIN bars b ON b.entity = pr.entity AND b.d = pr.d JOIN ss ON ss.d = pr.d JOIN ss sx ON sx.d = until),
    sd AS (SELECT *, p > n - greatest(1, floor(n * 0.2)) AS lg, p <= greatest(1, floor(n * 0.1)) AS sh FROM rk),
    pk AS (SELECT *, CASE WHEN lg THEN {long} / count(*) FILTER (lg) OVER (PARTITION BY d) WHEN sh THEN {short} / count(*) FILTER (sh) OVER (PARTITION BY d) END AS w FROM sd),
    hd AS (SELECT * FROM (SELECT entity, c0, due, w, open, unnest(generate_series(c0, due)) AS i FROM pk WHERE w IS NOT NULL AND open > 0)),
    mk AS (SELECT hd.*, coalesce(last_value(b.close IGNORE NULLS) OVER (PARTITION BY hd.entity, c0 ORDER BY hd.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hd.open) AS m FROM hd JOIN ss ON ss.i = hd.i LEFT JOIN bars b ON b.entity = hd.entity AND b.d = ss.d),
    gn AS (SELECT *, w * (m - coalesce(lag(m) OVER (PARTITION BY entity, c0 ORDER BY i), open)) / open AS g FROM mk),
    u AS (SELECT c0, i, sum(g) AS g, coalesce(sum(abs(w) * m / open) FILTER (i = due), 0) + coalesce(sum(abs(w)) FILTER (i = c0), 0) AS traded, coalesce(sum(w * m / open) FILTER (i < due), 0) AS net, coalesce(sum(abs(w) * m / open) FILTER (i < due), 0) AS gross FROM gn GROUP BY 1, 2),
    us AS (SELECT ss.i, list(struct_pack(c := c0, g := g, tr := traded, net := net, gross := gross) ORDER BY c0) FILTER (c0 IS NOT NULL) AS l FROM ss LEFT JOIN u ON u.i = ss.i GROUP BY 1),
    nav AS (SELECT 0::BIGINT AS i, 1.0::DOUBLE AS nav, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS net, 0.0::DOUBLE AS gross, []::DOUBLE[] AS starts
      UNION ALL SELECT i, start + pnl - cost, pnl, cost, net / (start + pnl - cost), gross / (start + pnl - cost), b FROM (SELECT us.i, n.nav AS start, list_append(n.starts, n.nav) AS b, coalesce(list_sum(list_transform(us.l, lambda x: list_append(n.starts, n.nav)[x.c] / 4.0 * x.g)), 0) AS pnl, coalesce(list_sum(list_transform(us.l, lambda x: list_append(n.starts, n.nav)[x.c] / 4.0 * x.tr)), 0) * 0.001 AS cost,
        coalesce(list_sum(list_transform(us.l, lambda x: list_append(n.starts, n.nav)[x.c] / 4.0 * x.net)), 0) AS net, coalesce(list_sum(list_transform(us.l, lambda x: list_append(n.starts, n.nav)[x.c] / 4.0 * x.gross)), 0) AS gross FROM nav n JOIN us ON us.i = n.i + 1))
    SELECT d, round(nav, 6) AS nav, round(nav / lag(nav, 1, 1.0) OVER (ORDER BY nav.i) - 1, 6) AS r, round(pnl, 6) AS pnl, round(cost, 6) AS cost, round(gross, 6) AS gross, round(net, 6) AS net, coalesce(lgs, 0) AS long_names, coalesce(shs, 0) AS short_names
    FROM nav JOIN ss ON ss.i = nav.i LEFT JOIN (SELECT c0, CAST(count(*) FILTER (lg) AS BIGINT) AS lgs, CAST({"0" if mode == "long-only" else "count(*) FILTER (sh)"} AS BIGINT) AS shs FROM sd GROUP BY 1) k ON k.c0 = ss.i"""


def _backtest(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    x = scored(spark, sf_dir).withColumn("until", F.lead("d", 3).over(ordered("entity", "d")))
    out = B.backtest(x, bars(spark, sf_dir), "d", "until", "entity", "score", mode, 4, 0.2, 0.1, cost_bps=10.0, least_names=1)
    return _round(out, "nav", "r", "pnl", "cost", "gross", "net").select("d", "nav", "r", "pnl", "cost", "gross", "net", "long_names", "short_names")


@query("i9_long_short_backtest", _backtest_sql("long-short"))
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backtest(spark, sf_dir, "long-short")


@query("i9_long_only_backtest", _backtest_sql("long-only"))
def long_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backtest(spark, sf_dir, "long-only")


@query(
    "m5_cross_fitted",
    f"""WITH {RETURNS}, b0 AS (SELECT entity, d, CASE WHEN r > 1 THEN 1 WHEN r < -1 THEN -1 ELSE r END AS r, volume FROM returns), x AS (SELECT entity, d, year(d) AS y, r, volume, lag(r) OVER w AS f, lead(d) OVER w AS e FROM b0 WINDOW w AS (PARTITION BY entity ORDER BY d)),
    c AS (SELECT x.*, coalesce(f, 0) AS f0 FROM x WHERE r IS NOT NULL AND e IS NOT NULL), yr AS (SELECT unnest([1996, 1997, 1998, 1999, 2000, 2001]) AS py),
    g AS (SELECT py, avg(f0) AS mf, avg(r) AS mr, sum(f0 * f0) - count(*) * avg(f0) * avg(f0) AS sxx, sum(f0 * r) - count(*) * avg(f0) * avg(r) AS sxy FROM c JOIN yr ON y < py AND year(e) < py GROUP BY 1)
    SELECT entity, d, round((mr - sxy / (sxx + 10.0) * mf) + sxy / (sxx + 10.0) * coalesce(f, 0), 6) AS prediction FROM x JOIN g ON y = py WHERE volume > 30""",
)
def cross_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("entity", "d")
    x = returns(spark, sf_dir)
    x = x.select("entity", "d", "volume", F.year("d").alias("y"), X.clip("r", -1.0, 1.0).alias("r"), X.clip(F.lag("r").over(w), -1.0, 1.0).alias("f"), F.lead("d").over(w).alias("e"))
    return _round(M.cross_fitted(x, "y", "e", ["f"], "r", list(range(1996, 2002)), 10.0, F.col("volume") > 30).select("entity", "d", "prediction"), "prediction")


@query(
    "x30_registrant_aliases",
    """WITH s AS (SELECT s_suppkey AS ticker, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN DATE '2001-01-01' + CAST(s_suppkey % 50 AS INTEGER) END AS until FROM supplier)
    SELECT ticker, 'Old ' || name AS alias, 'sec_former_name' AS alias_kind, DATE '1990-05-01' AS valid_from, until AS valid_to FROM s WHERE until IS NOT NULL UNION ALL SELECT ticker, name, 'sec_legal_name', coalesce(until + 1, DATE '2024-03-04'), NULL FROM s""",
)
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.concat(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("s_suppkey") % 50).cast("int")).cast("string"), F.lit("T00:00:00.000Z"))
    name = lambda n, a, b: F.struct(n.alias("name"), F.lit(a).alias("from"), b.alias("to"))
    former = F.when(F.col("s_suppkey") % 3 > 0, F.array(name(F.concat(F.lit("Old "), "s_name"), "1990-05-01T00:00:00.000Z", until), name(F.lit(" "), "1980-01-01", F.lit("1990-04-30")))).otherwise(F.array().cast("array<struct<name: string, `from`: string, `to`: string>>"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"), former.alias("formerNames"))).alias("payload"), F.lit("2024-03-04T10:00:00Z").alias("at"))
    return registrant_aliases(s, "s_suppkey", "payload", "at").select("ticker", "alias", "alias_kind", "valid_from", "valid_to")


@query("t13_quota_balanced")
def quota_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice", (F.col("p_size") % 5).alias("year"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("split"))
    return S.quota_balanced(p, "split", "p_retailprice", ["p_partkey"], "p_brand", "year", "p_type", 40)
