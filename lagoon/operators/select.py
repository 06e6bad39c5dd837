"""Selection: tails, argmin rows, keep-first and keep-last, quotas, even samples, robust thresholds."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def tails(df: DataFrame, score: str, group: Sequence[str], tie: str, fraction: float, least: int = 1) -> DataFrame:
    """Rows of the top (side 1) and bottom (side -1) fraction of each group, floor, at least `least`; others side 0.

    Ties go by `tie`, ascending, on both sides. names is the group's size. A row in both tails is on the upper.
    """
    up = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    down = Window.partitionBy(*group).orderBy(F.col(score).asc(), F.col(tie))
    whole = Window.partitionBy(*group)
    df = df.withColumns({"__u": F.row_number().over(up), "__l": F.row_number().over(down), "names": F.count(F.lit(1)).over(whole)})
    k = F.greatest(F.lit(least), F.floor(F.col("names") * F.lit(fraction) + 1e-9))
    return df.withColumn("side", F.when(F.col("__u") <= k, 1).when(F.col("__l") <= k, -1).otherwise(0)).drop("__u", "__l")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by a total order; dropDuplicates would take any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def smallest(df: DataFrame, group: Sequence[str], k: int, order: Sequence[Column | str]) -> DataFrame:
    """The first k rows of each group by the order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def namespaced_duplicates(df: DataFrame, keys: Sequence[str], kind: str, order: str) -> DataFrame:
    """Of rows that repeat keys and kind the last; later ones that collide on keys alone get a numbered kind."""
    last = keep_one(df, [*keys, kind], [F.col(order).desc()])
    w = Window.partitionBy(*keys).orderBy(order)
    return last.withColumn("__n", F.row_number().over(w)).withColumn(kind, F.when(F.col("__n") > 1, F.concat(kind, F.lit("_"), F.col("__n").cast("string"))).otherwise(F.col(kind))).drop("__n")


def even_sample(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """n rows evenly spaced in the order, the first and the last among them; all, if there are fewer.

    Numbered by range partition and local place, so that no task holds the order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    w = Window.orderBy("__part")
    counts = counts.select(F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    placed = ranged.join(F.broadcast(counts), F.col("__part") == F.col("__p")).withColumn("__i", F.col("__before") + F.col("__id") - F.col("__first"))
    # the j-th of n sits at floor(j (total - 1) / (n - 1)); i is one if some j maps to it
    if n <= 1:
        picked = placed.where(F.col("__i") < n)
    else:
        j = F.floor((F.col("__i") * (n - 1) + F.col("__total") - 2) / F.greatest(F.col("__total") - 1, F.lit(1)))
        picked = placed.where((F.col("__total") <= n) | (F.floor(j * (F.col("__total") - 1) / F.lit(n - 1)) == F.col("__i")))
    return picked.drop("__part", "__id", "__p", "__first", "__before", "__total", "__i")


def largest_remainder(shares: DataFrame, key: str, share: str, total: int) -> DataFrame:
    """Whole quotas that add up to `total`: floors, and one more for the largest remainders."""
    whole = Window.partitionBy()
    exact = F.lit(float(total)) * F.col(share) / F.sum(share).over(whole)
    q = shares.select(key, F.floor(exact + 1e-9).alias("quota"), (exact - F.floor(exact + 1e-9)).alias("rest"))
    q = q.withColumn("left", F.lit(total) - F.sum("quota").over(whole)).withColumn("n", F.row_number().over(Window.orderBy(F.col("rest").desc(), key)))
    return q.select(key, (F.col("quota") + F.when(F.col("n") <= F.col("left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def round_robin(df: DataFrame, group: Sequence[str], n: int, order: Sequence[Column | str]) -> DataFrame:
    """n rows taken in turns from the groups: all first ones, then all second ones, ... in the order."""
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return ranked.orderBy("turn", *order).limit(n)


def capped_greedy(df: DataFrame, split: str, score: str, tie: str, caps: dict[str, int], quota: int) -> DataFrame:
    """In each split the best rows in order, skipping those whose key in a capped column is used up.

    Each choice depends on those before, so a split runs in one task and must be bounded: a shortlist, not
    a corpus. With a single cap no row beyond it can be taken, and such rows are cut in parallel first.
    """
    out = df
    if len(caps) == 1:
        (col, cap), = caps.items()
        out = smallest(df, [split, col], cap, [F.col(score).desc(), F.col(tie)])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[tuple[str, object], int] = {}
        taken = []
        for i, row in enumerate(pdf.sort_values([score, tie], ascending=[False, True]).to_dict("records")):
            if len(taken) == quota:
                break
            if all(used.get((c, row[c]), 0) < cap for c, cap in caps.items()):
                taken.append(i)
                for c in caps:
                    used[c, row[c]] = used.get((c, row[c]), 0) + 1
        return pdf.sort_values([score, tie], ascending=[False, True]).iloc[taken]

    return out.groupBy(split).applyInPandas(pick, out.schema)


def quota_balanced(df: DataFrame, split: str, score: str, ties: Sequence[str], key: str, period: str, sector: str, quota: int, share: float = 0.7) -> DataFrame:
    """Up to `quota` rows of each split with reason: the best of them under caps, the rest in turns.

    `share` of the quota goes by score, ties ascending, skipping rows whose key already has three times, or whose
    period twice, an even part (at least 2 each): reason high_importance. The rest is dealt in turns from
    (period, sector), null sectors as Unknown: reason balanced_coverage. Choices depend on those before, so
    a split is one task; only what can be taken goes there: the first `quota` rows of each (key, period, sector) in order.
    """
    most = max(quota, 0)
    if not most:
        return df.limit(0).withColumn("reason", F.lit(None).cast("string"))
    order = [F.col(score).desc(), *ties]
    sizes = df.groupBy(split).agg(F.count(F.lit(1)).alias("__rows"), F.count_distinct(key).alias("__keys"), F.count_distinct(period).alias("__periods"))
    short = smallest(df, [split, key, period, sector], most, order).join(sizes, split)
    columns = df.columns

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.sort_values([score, *ties], ascending=[False, *[True] * len(ties)], kind="stable").reset_index(drop=True)
        n = min(most, int(ranked["__rows"].iloc[0]))
        first = min(n, math.ceil(n * share))
        caps = {key: max(2, math.ceil(first / max(int(ranked["__keys"].iloc[0]), 1) * 3)), period: max(2, math.ceil(first / max(int(ranked["__periods"].iloc[0]), 1) * 2))}
        used: Counter = Counter()
        best: list[int] = []
        for i, pair in enumerate(zip(ranked[key], ranked[period], strict=True)):
            if len(best) == first:
                break
            marks = list(zip(caps, pair, strict=True))
            if all(used[m] < caps[m[0]] for m in marks):
                best.append(i)
                used.update(marks)
        rest = ranked.drop(index=best)
        groups = [rest[period].astype(str), rest[sector].fillna("").replace("", "Unknown")]
        turns = rest.assign(__turn=rest.groupby(groups, sort=False).cumcount(), __g0=groups[0], __g1=groups[1]).sort_values(["__turn", "__g0", "__g1"], kind="stable")
        dealt = turns.head(n - len(best))
        return pd.concat([ranked.loc[best].assign(reason="high_importance"), dealt.assign(reason="balanced_coverage")])[[*columns, "reason"]]

    kind = StructType([*df.schema.fields, StructField("reason", StringType())])
    return short.groupBy(split).applyInPandas(pick, kind)


def robust_scale(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Rows with centre (median) and scale: 1.4826 MAD, or the population deviation if that is 0."""
    w = Window.partitionBy(*group)  # one exchange for all four figures; the table is read once
    mid = df.withColumns({"centre": F.median(value).over(w), "__sd": F.stddev_pop(value).over(w)})
    away = mid.withColumn("__mad", 1.4826 * F.median(F.abs(F.col(value) - F.col("centre"))).over(w))
    return away.withColumn("scale", F.when(F.col("__mad") > 0, F.col("__mad")).otherwise(F.col("__sd"))).drop("__mad", "__sd")


def robust_picks(df: DataFrame, value: str, group: Sequence[str], upper: float, lower: float) -> DataFrame:
    """side 1 for robust z >= upper, -1 for z <= -lower; others are left out."""
    z = F.try_divide(F.col(value) - F.col("centre"), F.nullif("scale", F.lit(0.0)))
    out = robust_scale(df, value, group).withColumn("z", z)
    return out.withColumn("side", F.when(F.col("z") >= upper, 1).when(F.col("z") <= -lower, -1)).where("side is not null")


def batches_of(values: Sequence, size: int) -> Iterator[Sequence]:
    for i in range(0, len(values), size):
        yield values[i : i + size]
