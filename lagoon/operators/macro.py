"""Market-wide features: macro releases as they were known, and surprises in news counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.exprs import clip
from lagoon.operators.calendar import densify, next_session, session_gaps
from lagoon.operators.ingest import vintage_replay
from lagoon.operators.panel import decay, forward_fill, ordered, prior_zscore
from lagoon.operators.select import keep_one


def release_events(vintages: DataFrame, series: str, observation: str, released: str, value: str, n: int = 36, least: int = 6) -> DataFrame:
    """The releases of `vintage_replay` with regime_z, how unusual the level is, and impulse_z, what is new in it.

    Each release is measured against those before it only. impulse_z is the z-score of the change of level
    (of the change between observations where there is none) and a quarter of that of the revisions, within 5.
    """
    w = ordered(series, released)
    d = vintage_replay(vintages, series, observation, released, value)
    z = lambda c: prior_zscore(c, w, n, least)
    d = d.withColumns({"regime_z": z("level"), "__r": z("release_delta"), "__p": z("period_change"), "__v": z("revision_delta")})
    impulse = F.coalesce("__r", "__p", F.lit(0.0)) + 0.25 * F.coalesce("__v", F.lit(0.0))
    return d.withColumn("impulse_z", clip(impulse, -5.0, 5.0)).drop("__r", "__p", "__v")


def macro_features(events: DataFrame, series: str, released: str, sessions: DataFrame, session: str, tau: float = 20.0) -> DataFrame:
    """(session, series, regime_z, impulse_z) for every session and series: the last regime known, and the last
    impulse worn off by exp(-sessions since / tau); 0 before the first release.

    A release counts from the first session after its date; of several on one session the last one does.
    The result is sessions times series, by definition; `macro_columns` puts series side by side.
    """
    placed = next_session(events.withColumn("__d", F.to_date(released)), "__d", sessions, session, "trade_date").where("trade_date is not null")
    last = keep_one(placed, [series, "trade_date"], [F.col(released).desc()]).select(series, "trade_date", "regime_z", "impulse_z")
    days = session_gaps(sessions, session).select(F.col("session").alias("trade_date"), "place")
    grid = densify(last, days.select("trade_date"), [series], "trade_date", {}).join(F.broadcast(days), "trade_date")
    w = ordered(series, "trade_date")
    since = F.col("place") - forward_fill(F.when(F.col("impulse_z").isNotNull(), F.col("place")), w)
    worn = decay(F.coalesce(forward_fill("impulse_z", w), F.lit(0.0)), F.coalesce(since, F.lit(0)), tau)
    return grid.select("trade_date", series, F.coalesce(forward_fill("regime_z", w), F.lit(0.0)).alias("regime_z"), worn.alias("impulse_z"))


def macro_columns(features: DataFrame, series: str, names: Sequence[str]) -> DataFrame:
    """One row a session with macro__<series>__regime_z and __impulse_z of the named series."""
    pick = lambda n, c: F.max(F.when(F.col(series) == n, F.col(c))).alias(f"macro__{n.lower()}__{c}")
    return features.where(F.col(series).isin(list(names))).groupBy("trade_date").agg(*[pick(n, c) for n in names for c in ("regime_z", "impulse_z")])


def news_surprise(events: DataFrame, date: str, category: str, categories: Sequence[str], impact: str, tone: str, volume: str, sessions: DataFrame, session: str, n: int = 252, least: int = 60) -> DataFrame:
    """Per session: how unusual counts (all and by category), impact, tone and volume of the news are.

    News counts on the first session after its date. Sessions without news have zeros, counts enter by
    log(1 + x), and each figure is measured against earlier sessions; 0 where they are too few. News without
    date or category is left out. Aggregated before the calendar is met, so the window runs over sessions only.
    """
    placed = next_session(events.where(F.col(date).isNotNull() & F.col(category).isNotNull()), date, sessions, session).where("trade_date is not null")
    counts = {f"event_count__{c.lower()}": F.count_if(F.col(category) == c) for c in categories}
    raw = placed.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("event_count_total"),
        F.avg(impact).alias("goldstein_mean"),
        F.sum(impact).alias("goldstein_sum"),
        F.avg(tone).alias("sentiment_mean"),
        F.log1p(F.coalesce(F.sum(F.greatest(F.col(volume).cast("double"), F.lit(0.0))), F.lit(0.0))).alias("media_volume_log"),
        *[x.alias(name) for name, x in counts.items()],
    )
    cols = [c for c in raw.columns if c != "trade_date"]
    days = session_gaps(sessions, session).select(F.col("session").alias("trade_date"))
    raw = raw.withColumn("__some", F.lit(True))
    value = lambda c: F.when(F.col("__some"), F.col(c).cast("double")).otherwise(0.0)
    full = days.join(raw, "trade_date", "left").withColumns({c: F.log1p(value(c)) if "count" in c else value(c) for c in cols})
    w = Window.orderBy("trade_date")  # the calendar, a few thousand rows
    return full.select("trade_date", *[F.coalesce(prior_zscore(c, w, n, least), F.lit(0.0)).alias(f"context__geo__{c}__surprise") for c in cols])
