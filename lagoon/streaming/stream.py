"""Structured Streaming variants: windowed counts, deduplication, upserts by batch, keyed folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def with_event_time(df: DataFrame, time: str, late: str) -> DataFrame:
    """The time as an instant, with a watermark; rows later than that are dropped by stateful operators."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(df: DataFrame, time: str, keys: Sequence[str], size: str, slide: str | None, measures: dict[str, str]) -> DataFrame:
    """Tumbling or sliding windows: window start and end, keys, n and the sum of each measure."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in measures.items()])
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *measures)


def sessions(df: DataFrame, time: str, keys: Sequence[str], gap: str) -> DataFrame:
    w = F.session_window(time, gap)
    g = df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_seen(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once, while the watermark keeps it."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def decayed_fold(df: DataFrame, key: str, time: str, tie: str, value: str, tau_days: float) -> DataFrame:
    """The keyed fold of the batch operator over a stream: (key, tie, before, events_before, late).

    State: worn sum, last instant, number of events. An event older than its key's state does not change
    it and comes out marked late, for a side table.
    """
    import math

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last, n = state.get if state.exists else (0.0, None, 0)
        rows = []
        for row in pd.concat(list(batches)).sort_values([time, tie]).itertuples(index=False):
            at = getattr(row, time).timestamp() / 86400.0
            if last is not None and at < last:
                rows.append((k[0], getattr(row, tie), None, n, True))
                continue
            before = 0.0 if last is None else level * math.exp(-(at - last) / tau_days)
            rows.append((k[0], getattr(row, tie), before, n, False))
            level, last, n = before + getattr(row, value), at, n + 1
        if last is not None:
            state.update((level, last, n))
        yield pd.DataFrame(rows, columns=[key, tie, "before", "events_before", "late"])

    out = f"{key} {df.schema[key].dataType.simpleString()}, {tie} {df.schema[tie].dataType.simpleString()}, before double, events_before bigint, late boolean"
    return df.groupBy(key).applyInPandasWithState(step, out, "level double, last double, n bigint", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is available into an in-memory table, for tests."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_sink(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Keep the last version of each key in versioned tables `path/v=<batch>`; a replayed batch rewrites its own.

    Each batch writes a whole new version from the one before, so a failed batch leaves the last good one.
    """
    from lagoon.operators.ingest import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number > 0:
            new = upsert(spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}"), batch, keys, order)
        else:
            from lagoon.operators.ingest import latest

            new = latest(batch, keys, order)
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
