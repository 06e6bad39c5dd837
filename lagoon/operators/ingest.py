"""Ingest shapes: upserts, vintage replay, nested JSON, ledgers, digests of configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.exprs import null_tokens, optional_number
from lagoon.operators.joins import asof_join


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last version of each key, by one aggregation with map-side combination.

    Whole rows are kept in the aggregate, so Spark sorts by key on both sides of the exchange; versions
    of a key are not sorted among themselves.
    """
    cols = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*cols), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("__row")[c].alias(c) for c in cols]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Old and new versions, the last of each key; replaying the same input changes nothing."""
    return latest(old.unionByName(new), keys, order)


def coalescing_upsert(versions: DataFrame, keys: Sequence[str], order: str, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """Per key: columns in `first` from the earliest version with a value, in `last` from the latest with one."""
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    return versions.groupBy(*keys).agg(*pick, F.min(order).alias("first_" + order), F.max(order).alias("last_" + order))


def purge_stale(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of the parents in `new` replaced by those in `new`."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def columnar_rows(df: DataFrame, key: str, payload: str, schema: str) -> DataFrame:
    """Rows from a JSON object of parallel arrays; unlike lengths are an error."""
    parsed = df.select(key, F.from_json(payload, schema).alias("j"))
    names = [f.name for f in parsed.schema["j"].dataType.fields]
    sizes = F.array(*[F.size(f"j.{n}") for n in names])
    checked = F.when(F.array_min(sizes) == F.array_max(sizes), F.arrays_zip(*[F.col(f"j.{n}").alias(n) for n in names])).otherwise(F.raise_error(F.lit("parallel arrays of unlike lengths")))
    return parsed.select(key, F.posexplode(checked).alias("place", "r")).select(key, "place", *[F.col("r")[n].alias(n) for n in names])


def object_rows(df: DataFrame, key: str, payload: str, field: str, numbers: Sequence[str], dates: Sequence[str], retrieved: str, reported: str | None = None) -> DataFrame:
    """A row per object of the array `field` of a JSON payload: numbers and dates, NULL for markers such as None.

    available_at is the last second of the `reported` date, or the time of retrieval if that is missing or not
    asked for. Payloads without such an array give nothing; the same object twice gives two rows.
    """
    objects = F.from_json(payload, f"struct<`{field}`: array<map<string, string>>>")[field]
    o = df.select(key, F.col(retrieved).cast("timestamp").alias("__at"), F.posexplode(objects).alias("place", "__o"))
    value = lambda c: F.try_element_at("__o", F.lit(c))
    day = lambda c: null_tokens(value(c)).try_cast("date")
    closed = F.col("__at") if reported is None else F.coalesce(day(reported).cast("timestamp") + F.expr("interval 86399 seconds"), F.col("__at"))
    return o.select(key, "place", *[optional_number(value(c)).alias(c) for c in numbers], *[day(c).alias(c) for c in dates], closed.alias("available_at"))


def nested_facts(df: DataFrame, key: str, payload: str, value: str, tags: Sequence[str] | None = None) -> DataFrame:
    """(key, taxonomy, tag, unit, fact fields) from taxonomy -> tag -> unit -> facts; unwanted tags go first."""
    kind = f"map<string, map<string, struct<label: string, units: map<string, array<{value}>>>>>"
    t = df.select(key, F.explode(F.from_json(payload, kind)).alias("taxonomy", "__tags"))
    t = t.select(key, "taxonomy", F.explode("__tags").alias("tag", "__body"))
    if tags is not None:
        t = t.where(F.col("tag").isin(list(tags)))
    u = t.select(key, "taxonomy", "tag", F.explode("__body.units").alias("unit", "__facts"))
    return u.select(key, "taxonomy", "tag", "unit", F.explode("__facts").alias("f")).select(key, "taxonomy", "tag", "unit", "f.*")


def wide_vintages(df: DataFrame, date: str, prefix: str = "vintage_") -> DataFrame:
    """(series, date, realtime_start, value) from columns SERIES_YYYYMMDD."""
    cols = [c for c in df.columns if c != date]
    long = df.unpivot(date, cols, "column", "value")
    at = F.to_date(F.regexp_extract("column", r"_([0-9]{8})$", 1), "yyyyMMdd")
    return long.select(F.regexp_replace("column", "_[0-9]{8}$", "").alias("series"), date, at.alias("realtime_start"), "value").where("value is not null")


def vintage_replay(df: DataFrame, series: str, observation: str, released: str, value: str) -> DataFrame:
    """Per series and release: the latest observation then known and its level, the change from the observation
    before it as then known, the change of level since the release before, and revision_delta, the mean change
    of the observations that the release gave anew (0 if it gave none).

    Of several values of one observation in one release the greatest counts. The two latest observations are
    running maxima over a series' releases; their values are as-of joins by observation. All steps are linear
    in the number of versions: releases never meet versions by a range.
    """
    versions = df.select(F.col(series).alias("s"), F.col(observation).alias("o"), F.col(released).alias("t"), F.col(value).alias("v")).where("s is not null and o is not null and t is not null and v is not null").groupBy("s", "o", "t").agg(F.max("v").alias("v"))
    steps = versions.withColumn("__step", F.col("v") - F.lag("v").over(Window.partitionBy("s", "o").orderBy("t")))
    by_time = Window.partitionBy("s").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.row_number().over(Window.partitionBy("s", "o").orderBy("t")) == 1  # later versions of an observation name no new one
    d = steps.withColumn("__new", F.when(fresh, F.col("o")))
    d = d.withColumn("__top", F.max("__new").over(by_time))
    d = d.withColumn("__before", F.lag("__top").over(Window.partitionBy("s").orderBy("t", "o")))
    d = d.withColumn("__second", F.when(F.col("__new").isNotNull() & F.col("__before").isNotNull(), F.least("__new", "__before")))
    d = d.withColumn("__next", F.max("__second").over(by_time))
    known = d.groupBy("s", "t").agg(F.max("__top").alias("latest"), F.max("__next").alias("__prior"), F.coalesce(F.avg("__step"), F.lit(0.0)).alias("revision_delta"))
    names = known.select("s", "t", "revision_delta", F.explode(F.array_compact(F.array(F.struct(F.lit(True).alias("top"), F.col("latest").alias("o")), F.when(F.col("__prior").isNotNull(), F.struct(F.lit(False).alias("top"), F.col("__prior").alias("o")))))).alias("n"))
    valued = asof_join(names.select("s", "t", "revision_delta", "n.top", "n.o"), versions, ["s", "o"], "t", "t", ["v"])
    side = lambda top, c: F.max(F.when(F.col("top") == top, F.col(c)))
    out = valued.groupBy("s", "t").agg(side(True, "o").alias("latest"), side(True, "v").alias("level"), (side(True, "v") - side(False, "v")).alias("period_change"), F.max("revision_delta").alias("revision_delta"))
    out = out.withColumn("release_delta", F.col("level") - F.lag("level").over(Window.partitionBy("s").orderBy("t")))
    return out.select(F.col("s").alias(series), F.col("t").alias(released), "latest", "level", "period_change", "release_delta", "revision_delta")


def pending(queue: DataFrame, ledger: DataFrame, key: str, done: Sequence[str] = ("ok", "empty"), retry: Sequence[str] = ()) -> DataFrame:
    """Queue rows whose key has no finished ledger entry; failures come back only if `retry` names them."""
    finished = ledger.where(~F.col("status").isin(list(retry))) if retry else ledger
    finished = finished.where(F.col("status").isin(*done) | ~F.col("status").isin(list(retry) or [""]))
    return queue.join(finished.select(key).distinct(), key, "left_anti")


def config_key(*cols: Column | str) -> Column:
    """sha256 of the columns as JSON: the key of a configuration row."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def validated(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): rows for which all rules hold, and the others with the names of those broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)
