"""Events: same-day clusters, per-entity chronological folds, incremental recomputation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.operators.aggs import vector_mean
from lagoon.operators.joins import similarity_forest, similarity_pairs


def connected_components(nodes: DataFrame, edges: DataFrame, key: str, left: str = "left", right: str = "right", rounds: int = 60) -> DataFrame:
    """(key, root): the least key each node reaches.

    Min-label propagation with pointer jumping; each round is an aggregation and two joins, checkpointed.
    """
    both = edges.select(F.col(left).alias("__a"), F.col(right).alias("__b"))
    both = both.unionByName(both.select(F.col("__b").alias("__a"), F.col("__a").alias("__b"))).distinct().checkpoint()
    state = nodes.select(F.col(key), F.col(key).alias("root")).distinct().checkpoint()
    for _ in range(rounds):
        low = both.join(state, F.col("__b") == F.col(key)).groupBy(F.col("__a").alias(key)).agg(F.min("root").alias("__low"))
        new = state.join(low, key, "left").select(key, F.least("root", F.coalesce("__low", "root")).alias("__new"), F.col("root").alias("__old"))
        jump = new.select(F.col(key).alias("__k"), F.col("__new").alias("__up"))
        new = new.join(jump, F.col("__new") == F.col("__k")).select(key, F.least("__new", "__up").alias("root"), "__old").checkpoint()
        moved = new.where("root <> __old").limit(1).count()
        state = new.drop("__old")
        if not moved:
            return state
    raise RuntimeError("components did not settle")


def cluster(df: DataFrame, key: str, day: str, vector: str, title: str, high: float, low: float = 2.0, title_tokens: str | None = None, least_jaccard: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) of same-day groups linked by similarity.

    members: key, cluster_id. clusters: cluster_id, day, representative (shortest title, then title, then
    key), size, and the mean member vector, normalised. cluster_id is 24 digits of the sha256 of the day and
    the sorted member keys.
    """
    if title_tokens or low < high:
        pairs = similarity_pairs(df, key, day, vector, title_tokens, high, low, least_jaccard)
    else:
        pairs = similarity_forest(df, key, day, vector, high)
    root = connected_components(df.select(key), pairs, key)
    d = df.join(root, key)
    ids = d.groupBy("root").agg(F.min(day).alias(day), F.min_by(key, F.struct(F.length(title), F.col(title), F.col(key))).alias("representative"), F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k.cast("string")), ",").alias("__keys"))
    ids = ids.withColumn("cluster_id", F.left(F.sha2(F.concat(F.col(day).cast("string"), F.lit("|"), "__keys"), 256), F.lit(24)))
    centre = vector_mean(d, ["root"], vector)
    clusters = ids.join(centre, "root").select("cluster_id", day, "representative", "size", vector)
    return root.join(ids.select("root", "cluster_id"), "root").select(key, "cluster_id"), clusters


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[Any, dict], tuple[Any, dict]], start: Any, out: T.StructType) -> DataFrame:
    """A state per key, carried over its rows in order: step(state, row) -> (state, output row).

    Rows come clustered by key and sorted, and are streamed in batches: a key's rows are never held
    together, only its state is. Keys are independent; one key's chain is sequential by nature.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, start
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                k = tuple(row[x] for x in keys)
                if k != key:
                    key, state = k, start
                state, made = step(state, row)
                rows.append(made)
            yield pd.DataFrame(rows, columns=out.fieldNames())

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, out)


def decayed_state(df: DataFrame, keys: Sequence[str], time: str, tie: str, value: str, tau_days: float) -> DataFrame:
    """Each event with the state before it: an exponentially worn sum and the number of earlier events."""

    def step(state: tuple | None, row: dict) -> tuple[tuple, dict]:
        import math

        at = row[time].timestamp() / 86400.0
        level, last, n = state if state is not None else (0.0, at, 0)
        if at < last:
            raise ValueError("an event is older than its state")
        before = level * math.exp(-(at - last) / tau_days)
        made = {**{k: row[k] for k in keys}, tie: row[tie], "before": before, "events_before": n}
        return (before + row[value], at, n + 1), made

    kinds = T.StructType([*[df.schema[k] for k in keys], df.schema[tie], T.StructField("before", T.DoubleType()), T.StructField("events_before", T.LongType())])
    return fold(df.select(*keys, time, tie, value), keys, [time, tie], step, None, kinds)


def group_digest(df: DataFrame, keys: Sequence[str], cols: Sequence[Column | str]) -> DataFrame:
    """keys, digest: changes if and only if the group's rows do; order plays no part.

    A sum of row hashes with the count, so partial aggregation applies and no group is gathered.
    """
    h = F.xxhash64(*cols)
    return df.groupBy(*keys).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)), 256).alias("digest"))


def changed_groups(df: DataFrame, keys: Sequence[str], cols: Sequence[str], known: DataFrame) -> DataFrame:
    """Rows of groups whose digest is new or differs from the known one: what must be recomputed."""
    now = group_digest(df, keys, cols)
    stale = now.join(known.select(*keys, F.col("digest").alias("__known")), list(keys), "left").where("__known is null or __known <> digest")
    return df.join(stale.select(*keys), list(keys), "left_semi")


def budget_stop(df: DataFrame, cost: str, cap: float, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in order up to and including the one whose cost brings the sum to the cap."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).where(F.col("spent_before") < cap)
