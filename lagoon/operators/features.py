"""Feature builders composed of the panel operators: price features, cross-sections, training frames, events.

Prices are one row per entity and session. Every feature of a row uses that session and earlier ones;
`training_frame` takes them from sessions strictly before the one that is traded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.exprs import clip, finite, ratio
from lagoon.operators.aggs import weighted_mean
from lagoon.operators.joins import assert_unique
from lagoon.operators.panel import ema, lags, log_return, change, ordered, pct_rank, rolling

EPS = 1e-8


@dataclass(frozen=True)
class Prices:
    """The names of a price table's columns."""

    key: str = "entity"
    time: str = "d"
    open: str = "open"
    high: str = "high"
    low: str = "low"
    close: str = "close"
    volume: str = "volume"


#: What `quant_features` adds, and what `cross_section` does.
QUANT = ["r1", "r5", "r21", "span", "gap", "volume_z", "vol20", "sma_ratio", "rsi", "macd", "roc3", "roc10", "vol_regime", "dollar_z", "weekday", "month_start", "month_end"]
CROSS = ["sector_relative", "volume_z_rank", "r5_rank"]


def quant_features(df: DataFrame, p: Prices = Prices(), time_is_date: bool = True) -> DataFrame:
    """The table with QUANT: returns, ranges, trend, risk, liquidity and calendar of each session.

    A feature without enough history, or with a divisor of 0, is NULL. Exponential means take two passes in
    Arrow batches; all other features share one exchange and one sort.
    """
    w = ordered(p.key, p.time)
    c = F.col(p.close)
    df = ema(df, {"__fast": (p.close, 12), "__slow": (p.close, 26)}, [p.key], [p.time])
    df = ema(df.withColumn("__line", F.col("__fast") - F.col("__slow")), {"__signal": ("__line", 9)}, [p.key], [p.time])
    before = F.lag(c).over(w)
    df = df.withColumns({
        "r1": log_return(c, 1, w), "r5": log_return(c, 5, w), "r21": log_return(c, 21, w),
        "roc3": change(c, 3, w), "roc10": change(c, 10, w),
        "span": ratio(F.col(p.high) - F.col(p.low), c), "gap": (F.col(p.open) - before) / (before + EPS),
        "__step": c - before, "__dollars": F.log1p(c * F.col(p.volume)),
    })
    z = lambda x: (F.col(x) - rolling(F.avg, x, 20, 5, w)) / (rolling(F.stddev_samp, x, 20, 5, w) + EPS)
    up, down = (rolling(F.avg, clip(F.col("__step") * s, 0.0, None), 14, 5, w) for s in (1, -1))
    df = df.withColumns({
        "volume_z": z(p.volume), "dollar_z": z("__dollars"), "vol20": rolling(F.stddev_samp, "r1", 20, 5, w),
        "sma_ratio": rolling(F.avg, c, 20, 5, w) / (rolling(F.avg, c, 200, 20, w) + EPS) - 1,
        "rsi": (50 - 100 / (1 + up / (down + EPS))) / 50,
        "macd": (F.col("__line") - F.col("__signal")) / (c + EPS),
        "vol_regime": rolling(F.stddev_samp, "r1", 5, 3, w) / (rolling(F.stddev_samp, "r1", 60, 20, w) + EPS) - 1,
        "weekday": F.weekday(p.time) / 4.0 - 0.5,
        "month_start": (F.dayofmonth(p.time) == 1).cast("double"),
        "month_end": (F.to_date(p.time) == F.last_day(p.time)).cast("double"),
    })
    return df.drop("__fast", "__slow", "__line", "__signal", "__step", "__dollars")


def cross_section(df: DataFrame, time: str, sector: str) -> DataFrame:
    """With CROSS: the return less its sector's mean that day, and centred ranks of the day; missing stays NULL."""
    return df.withColumns({
        "sector_relative": F.col("r1") - F.avg("r1").over(Window.partitionBy(time, sector)),
        "volume_z_rank": pct_rank("volume_z", [time]) - 0.5,
        "r5_rank": pct_rank("r5", [time]) - 0.5,
    })


EXTENDED = ["r63", "r126", "r252", "vol60", "vol252", "downside60", "off_high63", "off_high252", "volume_ratio", "illiquidity", "close_location", "body", "sector_relative21", "sector_relative63"]


def extended_features(df: DataFrame, sector: str, steps: Sequence[int] = (1, 5, 20), p: Prices = Prices()) -> tuple[DataFrame, list[str]]:
    """(table, names): EXTENDED, slow trend, risk, liquidity and price action, lagged by `steps`. Needs r1 and r21."""
    w = ordered(p.key, p.time)
    c, high, low = F.col(p.close), F.col(p.high), F.col(p.low)
    df = df.withColumns({f"r{k}": log_return(c, k, w) for k in (63, 126, 252)})
    df = df.withColumns({
        "vol60": rolling(F.stddev_samp, "r1", 60, 20, w), "vol252": rolling(F.stddev_samp, "r1", 252, 60, w),
        "downside60": rolling(F.stddev_samp, clip("r1", None, 0.0), 60, 20, w),
        "off_high63": c / rolling(F.max, c, 63, 20, w) - 1, "off_high252": c / rolling(F.max, c, 252, 60, w) - 1,
        "volume_ratio": rolling(F.avg, p.volume, 20, 5, w) / (rolling(F.avg, p.volume, 60, 20, w) + EPS) - 1,
        "illiquidity": rolling(F.avg, F.abs("r1") / (c * F.col(p.volume) + EPS), 20, 5, w),
        "close_location": (c - low) / (high - low + EPS) - 0.5, "body": c / (F.col(p.open) + EPS) - 1,
    })
    group = Window.partitionBy(p.time, sector)
    df = df.withColumns({f"sector_relative{k}": F.col(f"r{k}") - F.avg(f"r{k}").over(group) for k in (21, 63)})
    return lags(df, EXTENDED, steps, p.key, p.time), [f"{c}__lag{k}" for k in steps for c in EXTENDED]


def training_frame(prices: DataFrame, dimension: DataFrame, market: DataFrame, sector: str = "sector", steps: Sequence[int] = (1,), horizon: int = 1, features: Sequence[str] | None = None, p: Prices = Prices()) -> tuple[DataFrame, list[str]]:
    """(samples, names of features): a row per entity and traded session with a target, and features from before it.

    A sample is entered at its session's open and left at the close of the horizon-th session; the target
    is its return less the market's, and its centred rank that day. dimension: key, sector, a row a key;
    entities without one are left out. market: time, open, close, a row a session. Features are lagged by
    `steps` >= 1; infinities are NULL. sector_code numbers the sectors in order.
    """
    if horizon < 1 or min(steps) < 1:
        raise ValueError("horizon and steps begin at 1")
    assert_unique(dimension, [p.key], "the dimension")
    assert_unique(market, [p.time], "the market")
    wanted = list(features) if features is not None else [*QUANT, *CROSS]
    w = ordered(p.key, p.time)
    codes = dimension.select(sector).where(F.col(sector).isNotNull()).distinct().withColumn("sector_code", (F.row_number().over(Window.orderBy(sector)) - 1).cast("double"))
    df = prices.join(dimension.join(F.broadcast(codes), sector).select(p.key, sector, "sector_code"), p.key)
    df = cross_section(quant_features(df, p), p.time, sector)
    df = df.withColumns({"target_end": F.lead(p.time, horizon - 1).over(w), "raw_target": ratio(F.lead(p.close, horizon - 1).over(w), p.open) - 1})
    by_day = Window.orderBy(p.time)  # a market has a row a session
    m = market.select(p.time, (ratio(F.lead(p.close, horizon - 1).over(by_day), p.open) - 1).alias("market_target"))
    df = lags(df, wanted, steps, p.key, p.time)
    names = [f"{c}__lag{k}" for k in steps for c in wanted]
    df = df.withColumns({n: finite(n) for n in names}).join(m, p.time, "left")
    df = df.withColumn("target_alpha", F.col("raw_target") - F.col("market_target"))
    df = df.withColumn("target_rank", pct_rank("target_alpha", [p.time]) - 0.5).where("target_alpha is not null")
    return df.select(p.key, p.time, sector, *names, "sector_code", "target_end", "raw_target", "target_alpha", "target_rank"), [*names, "sector_code"]


@dataclass(frozen=True)
class Assessment:
    """The names of an assessment table's columns; categories are averaged by weight, counts are added up."""

    impact: str = "impact"
    confidence: str = "confidence"
    novelty: str = "novelty"
    persistence: str = "persistence"
    uncertainty: str = "uncertainty"
    disagreement: str = "disagreement"
    articles: str = "articles"
    domains: str = "domains"
    averaged: tuple[str, ...] = ()
    counted: tuple[str, ...] = ()


def assessment_features(df: DataFrame, keys: Sequence[str], a: Assessment = Assessment(), least_weight: float = 0.05, sign_band: float = 0.05) -> DataFrame:
    """Per key the reduction of its assessments to a fixed set of features.

    impact is the mean weighted by confidence; the others are weighted by max(least_weight, confidence x
    |impact|). confidence is the chance that one of them holds. Disagreement is the larger of the
    reported one and of the impact's spread, with a quarter more where signs conflict beyond the band.
    articles and domains are arrays: their distinct values are counted, blank domains not. The spread comes
    from sums of one pass: of confidences, of impacts and of their squares.
    """
    c, x = F.coalesce(F.col(a.confidence), F.lit(0.0)), F.col(a.impact)
    weight = F.greatest(F.lit(least_weight), c * F.abs(x))
    base = df.withColumns({"__w": weight, "__c": c})
    mean = weighted_mean(x, F.col("__c"))
    square = weighted_mean(x * x, F.col("__c"))
    distinct = lambda col: F.size(F.array_distinct(F.flatten(F.collect_set(col)))).cast("bigint")
    spread = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    conflict = F.when((F.max(x) > sign_band) & (F.min(x) < -sign_band), 1.0).otherwise(0.0)
    from lagoon.operators.aggs import noisy_or

    filled = F.filter(F.coalesce(F.col(a.domains), F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))
    return base.withColumn("__d", filled).groupBy(*keys).agg(
        mean.alias("signed_impact"),
        F.max(F.abs(x)).alias("max_absolute_impact"),
        noisy_or("__c").alias("confidence"),
        weighted_mean(a.novelty, "__w").alias("novelty"),
        weighted_mean(a.persistence, "__w").alias("persistence"),
        weighted_mean(a.uncertainty, "__w").alias("uncertainty_change"),
        F.greatest(weighted_mean(a.disagreement, "__w"), F.least(F.lit(1.0), spread + 0.25 * conflict)).alias("disagreement"),
        distinct(a.articles).alias("article_count"),
        F.count(F.lit(1)).alias("event_count"),
        distinct("__d").alias("source_count"),
        *[weighted_mean(n, "__w").alias(n) for n in a.averaged],
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in a.counted],
    )


def transaction_features(daily: DataFrame, key: str, time: str, counts: Sequence[str], windows: Sequence[int] = (5, 21, 63), bought: str = "purchase", sold: str = "sale", most: int = 252) -> DataFrame:
    """Rolling sums over sessions of a densified table of transactions, a row per key and session.

    Needs {bought,sold}_value, _count and planned_{bought,sold}_count beside `counts`. Per window: logs of
    the values and their difference, sums of counts, planned shares (0 without any); and sessions since the
    last purchase and sale, `most` at the most and where there was none.
    """
    w = ordered(key, time)
    flow = lambda name, n: F.sum(F.coalesce(F.col(name).cast("double"), F.lit(0.0))).over(w.rowsBetween(-(n - 1), 0))
    made: dict[str, Column] = {}
    for n in windows:
        buys, sells = F.log1p(flow(f"{bought}_value", n)), F.log1p(flow(f"{sold}_value", n))
        made |= {f"w{n}_{bought}_log": buys, f"w{n}_{sold}_log": sells, f"w{n}_net_log": buys - sells}
        made |= {f"w{n}_{c}": flow(c, n) for c in counts}
        for side in (bought, sold):
            made[f"w{n}_planned_{side}_share"] = F.coalesce(F.try_divide(flow(f"planned_{side}_count", n), F.nullif(flow(f"{side}_count", n), F.lit(0.0))), F.lit(0.0))
    place = F.row_number().over(w)
    df = daily.withColumns({**made, "__at": place})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    since = lambda c: F.least(F.coalesce(F.col("__at") - F.max(F.when(F.col(c) > 0, F.col("__at"))).over(so_far), F.lit(most)), F.lit(most))
    return df.withColumns({f"since_{s}": since(f"{s}_count") for s in (bought, sold)}).select(key, time, *made, f"since_{bought}", f"since_{sold}")


def select_columns(df: DataFrame, kinds: Sequence[str] = ("double", "float", "int", "bigint", "smallint", "tinyint"), prefix: str = "", holds: Sequence[str] = (), without: Sequence[str] = ()) -> list[str]:
    """Names of columns by type, beginning and what they hold, in the table's order."""
    wanted = lambda f: f.dataType.simpleString().split("(")[0] in kinds and f.name.startswith(prefix) and (not holds or any(h in f.name for h in holds)) and f.name not in without
    return [f.name for f in df.schema.fields if wanted(f)]


def least_filled(df: DataFrame, cols: Sequence[str], least: int) -> DataFrame:
    """Rows with a value in at least `least` of the columns."""
    return df.where(F.size(F.filter(F.array(*[F.col(c).isNotNull() for c in cols]), lambda x: x)) >= least)


def scaled(df: DataFrame, blocks: dict[str, tuple[Sequence[str], float]]) -> DataFrame:
    """Columns times the factor of the first block that names them; others stay."""
    factor: dict[str, float] = {}
    for cols, by in blocks.values():
        for c in cols:
            factor.setdefault(c, by)
    return df.withColumns({c: F.col(c) * F.lit(by) for c, by in factor.items()})


def gated(base: Column | str, correction: Column | str, active: Column, scale: float) -> Column:
    """base, plus scale x correction where active."""
    base, correction = (F.col(x) if isinstance(x, str) else x for x in (base, correction))
    return F.when(F.coalesce(active, F.lit(False)), base + F.lit(scale) * correction).otherwise(base)


def active(cols: Sequence[str]) -> Column:
    """Whether the columns, missing as 0, add up to more than 0."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return total > 0


def blended(df: DataFrame, time: str, sector: str, overall: str, specialist: str, weight: float) -> DataFrame:
    """With overall_rank (of the day), specialist_rank (of the day's sector), both centred, missing as 0, and blend."""
    rank = lambda x, g: F.coalesce(pct_rank(x, g) - 0.5, F.lit(0.0))
    df = df.withColumns({"overall_rank": rank(overall, [time]), "specialist_rank": rank(specialist, [time, sector])})
    return df.withColumn("blend", F.col("overall_rank") + F.lit(weight) * F.col("specialist_rank"))


def mean_rank(cols: Sequence[str], group: Sequence[str]) -> Column:
    """Mean of the columns' ranks in the group, over those with a value: a score of risk."""
    ranks = F.array_compact(F.array(*[pct_rank(c, group) for c in cols]))
    return F.when(F.size(ranks) > 0, F.aggregate(ranks, F.lit(0.0), lambda s, x: s + x) / F.size(ranks))


def bounded(df: DataFrame, shares: Sequence[str] = (), signed: Sequence[str] = (), counts: Sequence[str] = ()) -> DataFrame:
    """Predictions within their range: shares in 0..1, signed in -1..1, counts rounded half to even and not below 0."""
    made = {c: clip(c, 0.0, 1.0) for c in shares} | {c: clip(c, -1.0, 1.0) for c in signed}
    return df.withColumns(made | {c: F.greatest(F.bround(c), F.lit(0.0)) for c in counts})


class CoverageError(ValueError):
    pass


def coverage_gate(df: DataFrame, universe: DataFrame, key: str, least: float = 0.98) -> DataFrame:
    """The rows of `df` whose key is in the universe; an error if they cover too little of it. One small count."""
    have = universe.select(key).distinct().join(df.select(key).distinct().withColumn("__have", F.lit(1)), key, "left")
    r = have.agg(F.count(F.lit(1)).alias("all"), F.count("__have").alias("have")).first()
    if r["have"] < least * r["all"]:
        raise CoverageError(f"{r['have']} of {r['all']} keys are covered, under {least:.0%}")
    return df.join(universe.select(key).distinct(), key, "left_semi")


def text_vector(words: Column, rates: Sequence[Column], logs: Sequence[Column], flags: Sequence[Column], plain: Sequence[Column] = ()) -> Column:
    """A fixed array of doubles: values as they are, log1p of sizes, rates per word (0 without words), 0/1 flags."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    per_word = [F.coalesce(F.try_divide(zero(r), F.nullif(words.cast("double"), F.lit(0.0))), F.lit(0.0)) for r in rates]
    return F.array(*map(zero, plain), *[F.log1p(F.greatest(zero(x), F.lit(0.0))) for x in logs], *per_word, *[zero(F.coalesce(f, F.lit(False)).cast("int")) for f in flags])


def cost_sums(usage: DataFrame, prices: dict[str, dict[str, float]], keys: Sequence[str], model: str = "model", per: float = 1e6) -> DataFrame:
    """Per key the units of each kind and their cost; a model without a price costs nothing."""
    kinds = sorted({k for p in prices.values() for k in p})
    one = {k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m, p in sorted(prices.items()) for x in (m, float(p.get(k, 0.0)))]), F.col(model)), F.lit(0.0)) for k in kinds}
    cost = sum((F.coalesce(F.col(k), F.lit(0)) * one[k] for k in kinds), F.lit(0.0)) / F.lit(per)
    return usage.withColumn("__cost", cost).groupBy(*keys).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds], F.sum("__cost").alias("cost"))
