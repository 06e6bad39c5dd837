"""Evaluation of predictions by day: coefficients, spreads, paired comparisons, short sides, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.exprs import pearson, ratio
from lagoon.operators.aggs import mean_test
from lagoon.operators.joins import assert_unique
from lagoon.operators.panel import ordered, pct_rank, trailing_percentile


def with_raw_returns(df: DataFrame, prices: DataFrame, key: str, time: str, end: str, open_: str = "open", close: str = "close") -> DataFrame:
    """Rows with entry_open of their session and exit_close of session `end`, and raw_target between them.

    The price table plays both parts, joined on (key, time) twice; a key that repeats in it is an error.
    """
    assert_unique(prices, [key, time], "the price table")
    entry = prices.select(key, time, F.col(open_).alias("entry_open"))
    leave = prices.select(key, F.col(time).alias(end), F.col(close).alias("exit_close"))
    return df.join(entry, [key, time], "left").join(leave, [key, end], "left").withColumn("raw_target", ratio("exit_close", "entry_open") - 1)


def tail_means(group: Sequence[str], score: str, target: str, tie: str, fraction: float, least: int) -> tuple[Column, Column, Column]:
    """Window columns for one group: number of rows, and the row's target if it is in the upper, the lower tail."""
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    size = F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))
    up, down = F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie).desc())), F.row_number().over(w.orderBy(score, tie))
    return n, F.when((n >= least) & (up <= size), F.col(target)), F.when((n >= least) & (down <= size), F.col(target))


def daily_scores(df: DataFrame, time: str, prediction: str, target: str, tie: str, fraction: float = 0.1, least_names: int = 3, least_spread: int = 20) -> DataFrame:
    """Per day: names, ic (rank correlation; NULL for few names or a constant side), spread between the tails."""
    some = df.where(F.col(prediction).isNotNull() & F.col(target).isNotNull())
    n, upper, lower = tail_means([time], prediction, target, tie, fraction, least_spread)
    ranked = some.select(time, pct_rank(prediction, [time]).alias("__p"), pct_rank(target, [time]).alias("__t"), n.alias("__n"), upper.alias("__u"), lower.alias("__l"))
    return ranked.groupBy(time).agg(F.count(F.lit(1)).alias("names"), F.when(F.count(F.lit(1)) >= least_names, pearson("__p", "__t")).alias("ic"), (F.avg("__u") - F.avg("__l")).alias("spread"))


def prediction_scores(df: DataFrame, time: str, prediction: str, target: str, tie: str, regression: str | None = None) -> DataFrame:
    """One row: rows, half_accuracy (signs agree), rmse, prediction_std, mean_ic, ic_std, icir, ic_days, mean_spread.

    half_accuracy and rmse are against `regression`, the target if not given. p values: aggs.mean_test on
    the daily ic.
    """
    y = F.col(regression or target)
    e = F.col(prediction) - y
    some = df.where(F.col(prediction).isNotNull() & y.isNotNull())
    rows = some.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.signum(prediction) == F.signum(y)).cast("double")).alias("half_accuracy"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_pop(prediction).alias("prediction_std"))
    d = daily_scores(df, time, prediction, target, tie)
    days = d.agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("ic_days"), F.avg("spread").alias("mean_spread"))
    return rows.join(F.broadcast(days)).withColumn("icir", F.try_divide("mean_ic", F.nullif("ic_std", F.lit(0.0))))  # one row each


def paired_comparison(df: DataFrame, time: str, first: str, second: str, target: str, tie: str, active: Column) -> DataFrame:
    """Per day, on rows with all three: names, active rows, ic and spread of both predictions, ic on the active rows, lifts."""
    some = df.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(target).isNotNull()).withColumn("__on", F.coalesce(active, F.lit(False)))
    out = some.groupBy(time).agg(F.count_if("__on").alias("active_rows"))
    for name, col in (("first", first), ("second", second)):
        d = daily_scores(some, time, col, target, tie)
        out = out.join(d.select(time, "names", F.col("ic").alias(f"{name}_ic"), F.col("spread").alias(f"{name}_spread")) if name == "first" else d.select(time, F.col("ic").alias(f"{name}_ic"), F.col("spread").alias(f"{name}_spread")), time)
        on = daily_scores(some.where("__on"), time, col, target, tie)
        out = out.join(on.select(time, F.col("ic").alias(f"active_{name}_ic")), time, "left")
    # a day on which either side is constant compares nothing
    both = lambda a, b, x: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), x)
    out = out.withColumns({c: both("first_ic", "second_ic", F.col(c)) for c in ("first_ic", "second_ic")}).withColumns({c: both("active_first_ic", "active_second_ic", F.col(c)) for c in ("active_first_ic", "active_second_ic")})
    return out.withColumns({"ic_lift": F.col("second_ic") - F.col("first_ic"), "spread_lift": F.col("second_spread") - F.col("first_spread"), "active_ic_lift": F.col("active_second_ic") - F.col("active_first_ic")})


def short_side(df: DataFrame, time: str, key: str, models: Sequence[str], baseline: str, raw: str, alpha: str, fraction: float = 0.1) -> DataFrame:
    """Per day and model: the lowest tenth sold short: names, mean return and alpha, hit rates, overlap with the baseline's."""
    w = Window.partitionBy(time)
    size = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * F.lit(fraction)))
    # n smallest by each model in one pass: a row number a model
    picked = {f"__{m}": F.row_number().over(w.orderBy(F.col(m).asc_nulls_last(), key)) <= size for m in models}
    p = df.withColumns(picked).withColumn("__base", F.col(f"__{baseline}"))
    long = p.select(time, raw, alpha, "__base", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"__{m}").alias("on")) for m in models])).alias("m")).where("m.on")
    share = lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) < 0).cast("double")))
    return long.groupBy(time, F.col("m.model").alias("model")).agg(
        F.count(F.lit(1)).alias("names"), (-F.avg(raw)).alias("short_return"), (-F.avg(alpha)).alias("short_alpha"), share(raw).alias("declined"), share(alpha).alias("underperformed"), F.avg(F.col("__base").cast("double")).alias("overlap")
    )


def annual_ic(daily: DataFrame, time: str, lags: int) -> list[dict]:
    """Per year of a table of daily ic: mean, std, icir, positive share, days, and HAC p of the mean; a few rows."""
    d = daily.where(F.col("ic").isNotNull()).withColumn("__y", F.year(time))
    stats = d.groupBy("__y").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count(F.lit(1)).alias("days")).orderBy("__y").collect()
    return [{"year": r["__y"], "mean": r["mean"], "std": r["std"], "icir": r["mean"] / r["std"] if r["std"] else None, "positive": r["positive"], "days": r["days"], "p": mean_test(d.where(F.col("__y") == r["__y"]), "ic", time, lags)["p"]} for r in stats]


def dispersion_gate(daily: DataFrame, time: str, dispersion: str, spread: str, years: Sequence[int], thresholds: Sequence[float], cost_bps: float = 10.0, tolerance_bps: float = 0.5, n: int = 252, least: int = 60) -> tuple[DataFrame, DataFrame]:
    """(days, thresholds): trade only when dispersion is high among its own past.

    days: percentile, trade, gross and net contribution (0 when not traded; four legs of cost). thresholds: a row each with the share of days traded and mean gross and net in the
    validation `years`, and chosen: the lowest threshold whose net is within the tolerance of the best.
    The table has a row a session, so one window over all of it is small.
    """
    w = Window.orderBy(time)
    d = daily.withColumn("percentile", trailing_percentile(dispersion, w, n, least))
    cost = 4.0 * cost_bps * 1e-4
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    v = d.where(F.year(time).isin(list(years))).select("*", grid).withColumn("on", F.coalesce((F.col("percentile") >= F.col("threshold")).cast("double"), F.lit(0.0)))
    table = v.groupBy("threshold").agg(F.avg("on").alias("trade_share"), F.avg(F.col(spread) * F.col("on")).alias("gross"), F.avg((F.col(spread) - cost) * F.col("on")).alias("net"))
    best = F.max("net").over(Window.partitionBy())
    table = table.withColumn("__good", F.col("net") >= best - tolerance_bps * 1e-4)
    table = table.withColumn("chosen", F.col("__good") & (F.col("threshold") == F.min(F.when(F.col("__good"), F.col("threshold"))).over(Window.partitionBy()))).drop("__good")
    chosen = table.where("chosen").select(F.col("threshold").alias("__t"))
    out = d.join(F.broadcast(chosen)).withColumn("trade", F.coalesce(F.col("percentile") >= F.col("__t"), F.lit(False)).cast("int")).drop("__t")
    return out.withColumns({"gross": F.col(spread) * F.col("trade"), "net": (F.col(spread) - cost) * F.col("trade")}), table


def event_summary(events: DataFrame, splits: DataFrame, time: str, predicted: str, realised: str) -> DataFrame:
    """Per split (name, first, last; they may overlap): events, rank correlation, share of equal signs, mean of both.

    splits is a handful of date ranges and is broadcast; an event counts in each split that holds it.
    """
    held = events.join(F.broadcast(splits), F.col(time).between(F.col("first"), F.col("last"))).where(F.col(predicted).isNotNull() & F.col(realised).isNotNull())
    ranked = held.select("name", predicted, realised, pct_rank(predicted, ["name"]).alias("__p"), pct_rank(realised, ["name"]).alias("__r"))
    signs = F.when((F.col(predicted) != 0) & (F.col(realised) != 0), (F.signum(predicted) == F.signum(realised)).cast("double"))
    return ranked.groupBy("name").agg(F.count(F.lit(1)).alias("events"), pearson("__p", "__r").alias("ic"), F.avg(signs).alias("sign_accuracy"), F.avg(predicted).alias("mean_predicted"), F.avg(realised).alias("mean_realised"))


def kth_last(df: DataFrame, key: str, time: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, stale): each key's k-th last row, and the keys whose last session is not the table's last."""
    w = ordered(key, time)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc()))
    rows = df.withColumn("__n", last).where(F.col("__n") == k).drop("__n")
    ends = df.groupBy(key).agg(F.max(time).alias("last"))
    return rows, ends.join(F.broadcast(ends.agg(F.max("last").alias("__all")))).where("last < __all").drop("__all")
