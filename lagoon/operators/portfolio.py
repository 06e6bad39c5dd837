"""Portfolio evaluation: tail returns, turnover, overlapping cohorts, annualised figures."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lagoon.operators.panel import drawdown, wealth
from lagoon.operators.select import keep_one, robust_scale, tails


def tail_spread(df: DataFrame, day: str, score: str, target: str, tie: str, fraction: float, least_names: int) -> DataFrame:
    """Per day: names, mean target of the upper and the lower tail, and their difference."""
    t = tails(df.where(F.col(score).isNotNull() & F.col(target).isNotNull()), score, [day], tie, fraction).where(F.col("names") >= least_names)
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col(target)))
    out = t.groupBy(day).agg(F.max("names").cast("bigint").alias("names"), side(1).alias("upper"), side(-1).alias("lower"))
    return out.withColumn("spread", F.col("upper") - F.col("lower"))


def neutral_tails(df: DataFrame, day: str, group: str, score: str, target: str, tie: str, fraction: float, least_names: int = 5) -> DataFrame:
    """Per day: tail means within each group of at least `least_names`, groups weighted alike."""
    t = tails(df.where(F.col(score).isNotNull() & F.col(target).isNotNull()), score, [day, group], tie, fraction).where(F.col("names") >= least_names)
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col(target)))
    g = t.groupBy(day, group).agg(side(1).alias("upper"), side(-1).alias("lower"))
    return g.groupBy(day).agg(F.avg("upper").alias("upper"), F.avg("lower").alias("lower"), F.count(F.lit(1)).alias("groups"))


def turnover(picks: DataFrame, day: str, key: str, side: Sequence[str] = ()) -> DataFrame:
    """Per day (and side): 1 less the share of picks that were picks the day before; NULL for the first.

    A day's picks are a portfolio, so their set is small.
    """
    s = picks.groupBy(*side, day).agg(F.collect_set(key).alias("__s"))
    w = Window.partitionBy(*side).orderBy(day)
    before = F.lag("__s").over(w)
    return s.select(*side, day, F.size("__s").cast("bigint").alias("picks"), F.when(before.isNotNull(), 1 - F.size(F.array_intersect("__s", before)) / F.size("__s")).alias("turnover"))


def net_of_cost(spread: Column, turnover_: Column, bps: float, sides: int = 2) -> Column:
    """A spread less the cost of trading the turned-over share of both tails, in and out."""
    return spread - F.coalesce(turnover_, F.lit(1.0)) * F.lit(2.0 * sides * bps / 1e4)


def _placed(prices: DataFrame, day: str) -> tuple[DataFrame, list]:
    """(day, __i): the sessions with their places from 1, and their list.

    A calendar has a few thousand days; collected once, it does not drag the price table into every join.
    """
    days = sorted(r[0] for r in prices.where(F.col(day).isNotNull()).select(day).distinct().collect())
    kind = StructType([StructField(day, prices.schema[day].dataType), StructField("__i", IntegerType())])
    return prices.sparkSession.createDataFrame([(d, i) for i, d in enumerate(days, 1)], kind), days


def _cohort_units(entry: DataFrame, prices: DataFrame, key: str, open_col: str, close_col: str) -> DataFrame:
    """Per cohort and open session what one unit of it gains, turns over and holds.

    entry: (key, __c0 first place, __i1 last place, __w signed weight). prices: (key, __i, open, close). A missing
    close carries the last one since the entry. All of it is joins and windows; the result has a row per
    cohort and session.
    """
    p = prices.select(F.col(key), "__i", F.col(open_col).alias("__o"), F.col(close_col).alias("__c"))
    opened = entry.join(p.select(key, F.col("__i").alias("__c0"), F.col("__o").alias("__in")), [key, "__c0"]).where("__in > 0")
    held = opened.withColumn("__i", F.explode(F.sequence("__c0", "__i1"))).join(p.select(key, "__i", "__c"), [key, "__i"], "left")
    w = Window.partitionBy("__c0", key, "__w").orderBy("__i")
    held = held.withColumn("__mark", F.coalesce(F.last("__c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("__in")))
    held = held.withColumn("__gain", F.col("__w") * (F.col("__mark") - F.coalesce(F.lag("__mark").over(w), F.col("__in"))) / F.col("__in"))
    value = F.col("__w") * F.col("__mark") / F.col("__in")
    leaves, stays = F.col("__i") == F.col("__due"), F.col("__i") < F.col("__due")
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    return held.groupBy("__c0", "__i").agg(
        F.sum("__gain").alias("gain"),
        total(leaves, F.abs(value)).alias("exit"),
        total(F.col("__i") == F.col("__c0"), F.abs("__w")).alias("entry"),
        total(stays, F.abs(value)).alias("gross"),
        total(stays, value).alias("net"),
        F.count_distinct(F.when(stays, F.col("__due"))).alias("open"),
    )


def _nav_path(units: DataFrame, horizon: int, rate: float) -> DataFrame:
    """(__i, nav, r, pnl, cost, cohorts, gross, net): the recursion over sessions, run in one Arrow group.

    A cohort's budget is the net asset value before its first session over `horizon`. Rows are cohorts times
    their open sessions, bounded by the calendar; a session without cohorts has one row with a null cohort.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nav, budget, rows = 1.0, {}, []
        for i, g in pdf.sort_values(["__i", "__c0"]).groupby("__i", sort=True):
            start, pnl, cost, gross, net, cohorts = nav, 0.0, 0.0, 0.0, 0.0, 0
            for c0, gain, out, into, size, signed, still in zip(g["__c0"], g["gain"], g["exit"], g["entry"], g["gross"], g["net"], g["open"], strict=True):
                if pd.isna(c0):
                    continue
                if c0 == i:
                    budget[c0] = start / horizon
                b = budget[c0]
                pnl, cost = pnl + b * gain, cost + b * rate * (out + into)
                gross, net, cohorts = gross + b * size, net + b * signed, cohorts + int(still)
            nav = start + pnl - cost
            rows.append((int(i), nav, nav / start - 1 if start else 0.0, pnl, cost, cohorts, gross / nav if nav else None, net / nav if nav else None))
        return pd.DataFrame(rows, columns=["__i", "nav", "r", "pnl", "cost", "cohorts", "gross", "net"])

    cols = ["__c0", "__i", "gain", "exit", "entry", "gross", "net", "open"]
    return units.groupBy(F.lit(1).alias("__all")).applyInPandas(lambda k, pdf: run(pdf[cols]), "__i int, nav double, r double, pnl double, cost double, cohorts int, gross double, net double")


def simulate(picks: DataFrame, prices: DataFrame, day: str, key: str, side: str, horizon: int, cost_bps: float = 0.0, open_col: str = "open", close_col: str = "close") -> DataFrame:
    """Net asset value of overlapping cohorts: each day a sleeve of NAV / horizon is opened in that day's picks.

    picks: (day, key, side 1 or -1). A cohort enters at its day's opens with equal weights per side, is
    marked at closes (a missing close carries the last one) and leaves at the close of its horizon-th
    session; entries and exits cost `cost_bps` of the notional each. Positions of cohorts are not netted.
    """
    sessions, days = _placed(prices, day)
    p = prices.join(F.broadcast(sessions), day)
    c = picks.where(F.col(side).isin(1, -1)).join(F.broadcast(sessions), day).select(F.col(key), F.col(side).alias("__side"), F.col("__i").alias("__c0"))
    known = c.join(p.where(F.col(open_col) > 0).select(key, F.col("__i").alias("__c0")), [key, "__c0"])
    sides = known.groupBy("__c0").agg(F.count_distinct("__side").alias("__sides"))
    weight = F.lit(1.0) / (F.count(F.lit(1)).over(Window.partitionBy("__c0", "__side")) * F.col("__sides"))
    entry = known.join(sides, "__c0").withColumn("__w", weight * F.col("__side"))
    due = F.col("__c0") + F.lit(horizon - 1)
    entry = entry.select(key, "__c0", F.least(due, F.lit(len(days))).alias("__i1"), due.alias("__due"), "__w")
    path = _nav_path(_cohort_units(entry, p, key, open_col, close_col), horizon, cost_bps / 1e4)
    return path.join(sessions, "__i").select(day, "nav", "r")


def backtest(
    predictions: DataFrame,
    prices: DataFrame,
    day: str,
    end: str,
    key: str,
    score: str,
    mode: str = "long-short",
    horizon: int = 21,
    fraction: float = 0.1,
    short_fraction: float | None = None,
    long_z: float | None = None,
    short_z: float | None = None,
    cost_bps: float = 0.0,
    least_names: int = 20,
    open_col: str = "open",
    close_col: str = "close",
) -> DataFrame:
    """Daily path of a funded portfolio of overlapping sleeves: (day, nav, r, pnl, cost, cohorts, long_names,
    short_names, signal, gross, net), a row per session from the first prediction to the last `end`.

    Each day's names with prices are ranked by score, ties by key. Longs are the upper `fraction` (at least one),
    shorts the lower `short_fraction`; with thresholds they are names at least long_z robust deviations
    above, or short_z below, the day's median. A sleeve of NAV / horizon enters at the open, half a side (long-only:
    all of it long), and only if every side it trades has names. A name leaves at the close of its `end`;
    an `end` that is no session leaves at the last session before it. Missing closes carry the last one.
    A day with fewer than `least_names` priced names is an error, as are parameters out of range.
    """
    if mode not in ("long-only", "long-short"):
        raise ValueError(f"mode {mode!r}: long-only or long-short")
    short_fraction = fraction if short_fraction is None else short_fraction
    short_z = long_z if mode == "long-only" and short_z is None else short_z
    if horizon < 1 or not 0 < fraction < 0.5 or not 0 < short_fraction < 0.5:
        raise ValueError("horizon must be at least 1, fractions between 0 and 0.5")
    if (long_z is None) != (short_z is None) or (long_z is not None and min(long_z, short_z) <= 0):
        raise ValueError("both thresholds or none, and positive")
    quoted = keep_one(prices.where(F.col(open_col).isNotNull() & F.col(close_col).isNotNull()), [day, key], [F.col(open_col), F.col(close_col)])
    asked = predictions.where(F.col(day).isNotNull() & F.col(end).isNotNull() & F.col(score).isNotNull())
    begins, finishes = asked.agg(F.min(F.col(day).cast("date")), F.max(F.col(end).cast("date"))).first()
    within = F.col(day).cast("date").between(F.lit(begins), F.lit(finishes))
    quoted = quoted.where(within).select(day, key, open_col, close_col)
    sessions, _ = _placed(prices.where(within & F.col(open_col).isNotNull() & F.col(close_col).isNotNull()), day)
    p = quoted.join(F.broadcast(sessions), day)
    c = asked.select(day, key, F.col(score).cast("double").alias("__s"), F.col(end).cast("date").alias("__end")).join(p.select(day, key, F.col("__i").alias("__c0")), [day, key])
    of_day = Window.partitionBy("__c0")
    c = c.withColumns({"__n": F.count(F.lit(1)).over(of_day), "__rank": F.row_number().over(of_day.orderBy("__s", key))})
    if long_z is None:
        k = lambda f: F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(f)))
        long, short = F.col("__rank") > F.col("__n") - k(fraction), F.col("__rank") <= k(short_fraction)
    else:
        c = robust_scale(c, "__s", ["__c0"])
        z = F.when(F.col("scale") > 1e-12, (F.col("__s") - F.col("centre")) / F.col("scale"))
        long, short = F.coalesce(z >= long_z, F.lit(False)), F.coalesce(z <= -short_z, F.lit(False))
    too_few = F.concat(F.lit("fewer than "), F.lit(str(least_names)), F.lit(" names have prices on "), F.col(day).cast("string"))
    c = c.withColumn("__checked", F.when(F.col("__n") < least_names, F.raise_error(too_few)).otherwise(F.lit(True))).where("__checked")
    c = c.withColumns({"__l": F.count_if(long).over(of_day), "__h": F.count_if(short).over(of_day), "__long": long, "__short": short})
    signal = (F.col("__l") > 0) & ((F.col("__h") > 0) | F.lit(mode == "long-only"))
    half = 1.0 if mode == "long-only" else 0.5
    weight = F.when(F.col("__long"), half / F.col("__l")).when(F.col("__short") & F.lit(mode != "long-only"), -half / F.col("__h"))
    days = c.groupBy("__c0").agg(F.max("__l").cast("bigint").alias("long_names"), F.max("__h" if mode != "long-only" else F.lit(0)).cast("bigint").alias("short_names"), F.bool_or(signal).alias("signal"))
    until = sessions.select(F.col(day).cast("date").alias("__end"), F.col("__i").alias("__due"))
    beyond = F.date_add(F.greatest("__end", F.lit(finishes)), 1)
    calendar = until.select(F.col("__end").alias("__from"), F.date_sub(F.coalesce(F.lead("__end").over(Window.orderBy("__end")), beyond), 1).alias("__last"), "__due")
    every_day = calendar.select(F.explode(F.sequence("__from", "__last")).alias("__end"), "__due")  # every date with the last session at or before it
    entry = c.where(signal).withColumn("__w", weight).where("__w is not null").join(F.broadcast(every_day), "__end").where("__due >= __c0")
    units = _cohort_units(entry.select(key, "__c0", F.col("__due").alias("__i1"), "__due", "__w"), p, key, open_col, close_col)
    path = _nav_path(sessions.select("__i").join(units, "__i", "left"), horizon, cost_bps / 1e4)
    counted = sessions.join(days.withColumnRenamed("__c0", "__i"), "__i", "left").na.fill({"long_names": 0, "short_names": 0, "signal": False})
    return path.join(counted, "__i").select(day, "nav", "r", "pnl", "cost", "cohorts", "long_names", "short_names", "signal", "gross", "net")


def annualised(df: DataFrame, group: Sequence[str], order: str, r: str, periods: float = 252.0) -> DataFrame:
    """Per group: days, total return, annual mean and deviation, Sharpe ratio, deepest drawdown."""
    w = Window.partitionBy(*group).orderBy(order)
    d = df.where(F.col(r).isNotNull()).withColumn("__v", wealth(r, w)).withColumn("__dd", drawdown("__v", w))
    mean, sd = F.avg(r) * periods, F.stddev_samp(r) * periods**0.5
    return d.groupBy(*group).agg(
        F.count(F.lit(1)).alias("days"), (F.max_by("__v", order) - 1).alias("total"), mean.alias("mean"), sd.alias("vol"), F.try_divide(mean, F.nullif(sd, F.lit(0.0))).alias("sharpe"), F.min("__dd").alias("max_drawdown")
    )
