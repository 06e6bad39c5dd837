"""Session calendars: strictly-later joins, decision sessions, densified panels, generated dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def day_range(spark: SparkSession, first: str, last: str, name: str, step: str = "1 day") -> DataFrame:
    """Dates from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval {step}"))).alias(name))


def span_of(df: DataFrame, col: str, name: str, step: str = "1 day") -> DataFrame:
    """Dates from the least to the greatest of a column; none for an empty table."""
    ends = df.agg(F.min(col).cast("date").alias("__a"), F.max(col).cast("date").alias("__b")).where("__a is not null")
    return ends.select(F.explode(F.sequence("__a", "__b", F.expr(f"interval {step}"))).alias(name))


def session_gaps(sessions: DataFrame, col: str) -> DataFrame:
    """Each session with its place and the one before: (after, session, place) covers dates after < d <= session."""
    w = Window.orderBy(col)
    days = sessions.select(F.col(col).cast("date").alias(col)).where(F.col(col).isNotNull()).distinct()
    return days.select(F.lag(col).over(w).alias("after"), F.col(col).alias("session"), F.row_number().over(w).alias("place"))


def calendar_days(sessions: DataFrame, col: str, reach: int = 40) -> DataFrame:
    """(day, next_session, next_place, same_place): every day from `reach` before the first session to the last.

    A calendar has a few thousand days, so a join with it is an equi-join on the day, broadcast; facts
    never meet a range predicate.
    """
    g = session_gaps(sessions, col)
    begin = F.coalesce(F.col("after"), F.date_sub("session", reach))
    spread = g.select("session", "place", F.explode(F.sequence(begin, F.date_sub("session", 1))).alias("day"))
    same = g.select(F.col("session").alias("day"), F.col("place").alias("same_place"))
    return spread.select("day", F.col("session").alias("next_session"), F.col("place").alias("next_place")).join(same, "day", "full_outer")


def next_session(df: DataFrame, date: str, sessions: DataFrame, col: str, name: str = "trade_date") -> DataFrame:
    """The first session strictly after the row's date; NULL beyond the calendar."""
    days = calendar_days(sessions, col).select(F.col("day").alias("__day"), F.col("next_session").alias(name))
    return df.join(F.broadcast(days), F.col(date).cast("date") == F.col("__day"), "left").drop("__day")


def decision_session(df: DataFrame, instant: str, sessions: DataFrame, col: str, zone: str = "America/New_York", close_hour: int = 16, name: str = "trade_date") -> DataFrame:
    """The session whose open may know an instant.

    On a session before its close: the next one; after the close: the one after that; on another day: the
    next session counts as the day, so the one after it. NULL beyond the calendar.
    """
    local = F.from_utc_timestamp(F.col(instant).cast("timestamp"), zone)
    days = F.broadcast(calendar_days(sessions, col).select(F.col("day").alias("__day"), "same_place", "next_place"))
    places = F.broadcast(session_gaps(sessions, col).select(F.col("place").alias("__place"), F.col("session").alias(name)))
    df = df.withColumn("__local", local).join(days, F.to_date("__local") == F.col("__day"), "left")
    on_session = F.col("same_place").isNotNull()
    target = F.when(on_session & (F.hour("__local") < close_hour), F.col("same_place") + 1).when(on_session, F.col("same_place") + 2).otherwise(F.col("next_place") + 1)
    return df.withColumn("__want", target).join(places, F.col("__want") == F.col("__place"), "left").drop("__local", "__day", "same_place", "next_place", "__want", "__place")


def deferred(df: DataFrame, trade_date: str = "trade_date") -> DataFrame:
    """How many rows lie beyond the calendar."""
    return df.agg(F.count_if(F.col(trade_date).isNull()).alias("deferred"), F.count_if(F.col(trade_date).isNotNull()).alias("placed"))


def densify(df: DataFrame, days: DataFrame, keys: Sequence[str], day: str, fill: dict[str, object]) -> DataFrame:
    """Every key on every day; missing measures NULL, or as `fill` says.

    Days are generated per key from a broadcast calendar: the result is keys x days by definition.
    """
    grid = df.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct().crossJoin(F.broadcast(days.select(day)))
    return grid.join(df, [*keys, day], "left").na.fill(fill)
