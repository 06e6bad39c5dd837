"""Aggregations: guarded and weighted means, robust scales, information coefficients, HAC tests, deciles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.exprs import pearson
from lagoon.operators.panel import pct_rank


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Over rows with a value; the plain mean if their weights add up to 0."""
    x, w = _c(x), _c(w)
    some = F.when(x.isNotNull(), F.coalesce(w, F.lit(0.0)))
    return F.coalesce(F.try_divide(F.sum(x * some), F.nullif(F.sum(some), F.lit(0.0))), F.avg(x))


def noisy_or(p: Column | str) -> Column:
    """1 - prod(1 - p); 1 if some p is 1."""
    p = _c(p)
    return F.when(F.max(p) >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.log(F.when(p < 1, 1 - p)))))


def capped_sum(x: Column | str, cap: float) -> Column:
    """Sum with missing and negative values as 0 and each at most the cap."""
    x = _c(x)
    return F.sum(F.when(x.isNull() | (x < 0), 0.0).when(x > cap, cap).otherwise(x))


def assessment_summary(df: DataFrame, keys: Sequence[str], impact: str, confidence: str, members: str, above: float | None = None) -> DataFrame:
    """Per key: confidence-weighted mean and variance, noisy-or, strongest, sign conflict, distinct members.

    members is an array; the distinct ones but NULL are counted over all rows. above: keys whose confidences do not
    add up to more are left out; without it they have the plain mean.
    """
    mean = df.groupBy(*keys).agg(weighted_mean(impact, confidence).alias("mean"), F.sum(confidence).alias("__sum"))
    if above is not None:
        mean = mean.where(F.col("__sum") > above)
    d = df.join(mean.drop("__sum"), list(keys))
    spread = weighted_mean(F.pow(F.col(impact) - F.col("mean"), 2), confidence)
    up, down = F.max((F.col(impact) > 0).cast("int")), F.max((F.col(impact) < 0).cast("int"))
    return d.groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        spread.alias("variance"),
        noisy_or(confidence).alias("confidence"),
        F.max_by(impact, F.struct(F.abs(F.col(impact)), F.col(impact))).alias("strongest"),
        (F.coalesce(up, F.lit(0)) * F.coalesce(down, F.lit(0))).alias("conflict"),
        F.count(F.lit(1)).alias("assessments"),
        F.size(F.array_compact(F.array_distinct(F.flatten(F.collect_list(members))))).cast("bigint").alias("members"),
    )


def vector_mean(df: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean of arrays, normalised to length 1: keys, vector.

    Sums are per position, with partial aggregation on the map side; no group's vectors come together.
    """
    w = F.lit(1.0) if weight is None else weight
    flat = df.select(*keys, w.cast("double").alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    sums = flat.groupBy(*keys, "__i").agg((F.sum(F.col("__x").cast("double") * F.col("__w")) / F.sum("__w")).alias("__m"))
    packed = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("__v"))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))
    return packed.withColumn("__n", norm).select(*keys, F.when(F.col("__n") > 0, F.transform("__v", lambda x: x / F.col("__n"))).alias(vector))


def rank_ic(df: DataFrame, group: Sequence[str], prediction: str, target: str, least: int = 3) -> DataFrame:
    """Spearman correlation per group over rows with both; NULL for a constant side; groups under `least` absent."""
    both = df.where(F.col(prediction).isNotNull() & F.col(target).isNotNull())
    r = both.withColumns({"__p": pct_rank(prediction, group), "__t": pct_rank(target, group)})
    return r.groupBy(*group).agg(pearson("__p", "__t").alias("ic"), F.count(F.lit(1)).alias("names")).where(F.col("names") >= least)


def feature_ic(df: DataFrame, day: str, period: Column, features: Sequence[str], target: str, least: int = 3) -> DataFrame:
    """period, feature: mean, deviation and positive share of the daily IC, and the share of missing values.

    A coefficient that is 0 but for rounding is not positive.
    """
    stacked = df.withColumn("__period", period).unpivot(["__period", day, target], list(features), "feature", "__x")
    missing = stacked.groupBy("__period", "feature").agg(F.avg(F.col("__x").isNull().cast("double")).alias("missing"))
    ic = rank_ic(stacked, ["__period", day, "feature"], "__x", target, least)
    out = ic.groupBy("__period", "feature").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.round("ic", 12) > 0).cast("double")).alias("positive"), F.count("ic").alias("days"))
    return missing.join(out, ["__period", "feature"], "left").withColumnRenamed("__period", "period")


def deciles(df: DataFrame, day: str, score: str, target: str, tie: str, n: int = 10) -> DataFrame:
    """decile: mean, deviation, days and standard error of the daily mean target; ties in score by `tie`."""
    w = Window.partitionBy(day)
    some = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    pct = F.row_number().over(w.orderBy(score, tie)) / F.count(F.lit(1)).over(w)
    some = some.withColumn("decile", F.least(F.greatest(F.ceil(pct * n - 1e-9), F.lit(1)), F.lit(n)).cast("int"))
    daily = some.groupBy(day, "decile").agg(F.avg(target).alias("m"))
    return daily.groupBy("decile").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.count("m").alias("days")).withColumn("se", F.col("std") / F.sqrt("days"))


def hac_mean(df: DataFrame, value: str, order: str, lags: int) -> DataFrame:
    """One row: n, mean, se (Newey-West, Bartlett weights), t. The series is one value a day, so it is small.

    Autocovariances divide by n, the variance of the mean by n again.
    """
    w = Window.orderBy(order)
    s = df.where(F.col(value).isNotNull()).select(order, F.col(value).alias("x"))
    mean = s.agg(F.avg("x").alias("m"), F.count("x").alias("n"))
    c = s.join(F.broadcast(mean)).withColumn("e", F.col("x") - F.col("m"))
    terms = [F.coalesce(F.sum(F.col("e") * F.col("e")), F.lit(0.0)).alias("g0")] + [F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)]
    c = c.withColumns({f"e{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)}) if lags else c
    g = c.groupBy("m", "n").agg(*terms)
    var = F.col("g0")
    for k in range(1, lags + 1):
        var = var + F.lit(2.0 * (1 - k / (lags + 1))) * F.col(f"g{k}")
    se = F.sqrt(F.greatest(var, F.lit(0.0))) / F.col("n")
    return g.select(F.col("n"), F.col("m").alias("mean"), se.alias("se"), F.try_divide("m", F.nullif(se, F.lit(0.0))).alias("t"))


def t_two_sided(t: float, df: int) -> float:
    """p of a Student t by the regularised incomplete beta function (continued fraction)."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1.0))
        out = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1.0 + num * d or 1e-300)
                c = 1.0 + num / c or 1e-300
                out *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return out

    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * fraction(a, b, x) / a)
    return min(1.0, max(0.0, 1.0 - front * fraction(b, a, 1.0 - x) / b))


def mean_test(df: DataFrame, value: str, order: str, lags: int, zero_se: str = "certain") -> dict[str, float | None]:
    """Mean and p of hac_mean on the driver. A standard error of 0 gives p 0 (1 for mean 0), or None if `unknown`."""
    r = hac_mean(df, value, order, lags).first()
    if r is None or r["n"] < 2:
        return {"mean": r["mean"] if r else None, "p": None}
    if not r["se"]:
        return {"mean": r["mean"], "p": None if zero_se == "unknown" else (0.0 if r["mean"] else 1.0)}
    return {"mean": r["mean"], "p": t_two_sided(r["t"], r["n"] - 1)}


def concentration(df: DataFrame, key: str) -> DataFrame:
    """names, highest share and Herfindahl index of how often each key was selected."""
    k = F.col("k").cast("double")
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    return c.agg(F.count(F.lit(1)).alias("names"), F.try_divide(F.max(k), F.sum(k)).alias("max_share"), F.try_divide(F.sum(k * k), F.sum(k) * F.sum(k)).alias("hhi"))


def regression_metrics(df: DataFrame, group: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """mae, rmse, r2 and correlation per group."""
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*group).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(actual) * F.count(actual), F.lit(0.0)))).alias("r2"), pearson(actual, predicted).alias("r")
    )


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """rows, rows with some non-zero value, and their share."""
    active = F.exists(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]), lambda x: x != 0)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(active).alias("active")).withColumn("share", F.try_divide("active", "rows"))


def frequent_edges(df: DataFrame, key: str, domain: str, paragraphs: Column, head: int = 2, tail: int = 3, low: int = 40, high: int = 500, least: int = 5, share: float = 0.15) -> DataFrame:
    """Boilerplate: paragraphs among the first or last few of documents that many documents of a domain have.

    Columns: domain, paragraph, documents. Threshold: max(least, ceil(share x documents of the domain)).
    """
    d = df.select(key, domain, paragraphs.alias("__p"))
    n = F.size("__p")
    edge = F.array_distinct(F.concat(F.slice("__p", 1, head), F.when(n > 0, F.slice("__p", F.greatest(n - tail + 1, F.lit(1)), F.lit(tail))).otherwise(F.array().cast("array<string>"))))
    each = d.select(key, domain, F.explode(edge).alias("paragraph")).where(F.length("paragraph").between(low, high))
    many = each.groupBy(domain, "paragraph").agg(F.count(F.lit(1)).alias("documents"))
    totals = d.groupBy(domain).agg(F.count(F.lit(1)).alias("__all"))
    return many.join(totals, domain).where(F.col("documents") >= F.greatest(F.lit(least), F.ceil(F.col("__all") * share - 1e-9))).drop("__all")
