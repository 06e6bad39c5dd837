"""Window operators over an entity-by-time panel.

Every operator takes a frame and names, adds columns and is lazy. A row's value depends on no later row
of its entity: frames end at the row or, for the prior-only forms, before it. Operators of one entity and
order share a single exchange and sort, since Spark plans equal window specifications together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lagoon.functions.exprs import clip, dot, ratio

START, NOW = Window.unboundedPreceding, Window.currentRow


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(keys: str | Sequence[str], time: str | Sequence[str]) -> WindowSpec:
    """Rows of an entity in time order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    time = [time] if isinstance(time, str) else list(time)
    return Window.partitionBy(*keys).orderBy(*time)


def lags(df: DataFrame, cols: Sequence[str], steps: Sequence[int], keys: str, time: str) -> DataFrame:
    """Columns c__lagK: the value K rows before."""
    w = ordered(keys, time)
    return df.withColumns({f"{c}__lag{k}": F.lag(c, k).over(w) for c in cols for k in steps})


def change(x: Column | str, k: int, w: WindowSpec) -> Column:
    """x over its value k rows before, less 1; NULL where that is missing or 0."""
    return ratio(_c(x), F.lag(_c(x), k).over(w)) - 1


def log_return(x: Column | str, k: int, w: WindowSpec) -> Column:
    c = change(x, k, w)
    return F.when(c > -1, F.log1p(c))


def rolling(agg, x: Column | str, n: int, least: int, w: WindowSpec, prior: bool = False) -> Column:
    """agg over the last n rows (before the current one, if `prior`) with at least `least` values."""
    frame = w.rowsBetween(-n, -1) if prior else w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(_c(x)).over(frame) >= least, agg(_c(x)).over(frame))


def expanding(agg, x: Column | str, least: int, w: WindowSpec, prior: bool = False) -> Column:
    frame = w.rowsBetween(START, -1 if prior else NOW)
    return F.when(F.count(_c(x)).over(frame) >= least, agg(_c(x)).over(frame))


def zscore(x: Column | str, n: int, least: int, w: WindowSpec, guard: float = 1e-8) -> Column:
    """(x - mean) / (std + guard) over frames that include the row."""
    return (_c(x) - rolling(F.avg, x, n, least, w)) / (rolling(F.stddev_samp, x, n, least, w) + guard)


def prior_zscore(x: Column | str, w: WindowSpec, n: int = 36, least: int = 6, bound: float | None = 5.0, fallback: bool = True) -> Column:
    """Against rows before only; with too few of them in the frame, against all before."""
    mean, std = rolling(F.avg, x, n, least, w, prior=True), rolling(F.stddev_samp, x, n, least, w, prior=True)
    if fallback:
        mean = F.coalesce(mean, expanding(F.avg, x, least, w, prior=True))
        std = F.coalesce(std, expanding(F.stddev_samp, x, least, w, prior=True))
    z = F.try_divide(_c(x) - mean, F.nullif(std, F.lit(0.0)))
    return z if bound is None else clip(z, -bound, bound)


def trailing_percentile(x: Column | str, w: WindowSpec, n: int = 252, least: int = 60) -> Column:
    """Share of the up to n earlier values that are at most x; needs `least` of them."""
    before = F.collect_list(_c(x)).over(w.rowsBetween(-n, -1))
    return F.when(_c(x).isNotNull() & (F.size(before) >= least), F.size(F.filter(before, lambda v: v <= _c(x))) / F.size(before))


def forward_fill(x: Column | str, w: WindowSpec, limit: int | None = None) -> Column:
    """Last value at or before the row, at most `limit` rows back."""
    frame = w.rowsBetween(START if limit is None else -limit, NOW)
    return F.last(_c(x), ignorenulls=True).over(frame)


def add_rows_since(df: DataFrame, name: str, flag: Column, keys: str, time: str, most: int = 252) -> DataFrame:
    """Rows since the flag last held; `most` at the most and where it never did."""
    w = ordered(keys, time)
    df = df.withColumn("__pos", F.row_number().over(w))
    last = F.max(F.when(flag, F.col("__pos"))).over(w.rowsBetween(START, NOW))
    return df.withColumn(name, F.least(F.coalesce(F.col("__pos") - last, F.lit(most)), F.lit(most))).drop("__pos")


def decay(impulse: Column | str, age: Column | str, tau: float) -> Column:
    """The last impulse, worn off by exp(-age / tau)."""
    return _c(impulse) * F.exp(-_c(age) / F.lit(tau))


def pct_rank(x: Column | str, group: Sequence[str | Column]) -> Column:
    """Rank among the group's values, ties averaged, over their number; NULL stays NULL.

    Not percent_rank(), which takes the lowest tie and counts from 0.
    """
    x = _c(x)
    w = Window.partitionBy(*group)
    by_value = w.orderBy(x.asc_nulls_last())
    peers = F.count(x).over(by_value.rangeBetween(NOW, NOW))  # in the order of the rank: no exchange, no sort of its own
    return F.when(x.isNotNull(), (F.rank().over(by_value) + (peers - 1) / 2.0) / F.count(x).over(w))


def centred_rank(x: Column | str, group: Sequence[str]) -> Column:
    """pct_rank less one half; missing as 0."""
    return F.coalesce(pct_rank(x, group) - 0.5, F.lit(0.0))


def demean(x: Column | str, group: Sequence[str]) -> Column:
    return _c(x) - F.avg(_c(x)).over(Window.partitionBy(*group))


def add_rsi(df: DataFrame, price: str, keys: str, time: str, n: int = 14, least: int = 5, name: str = "rsi") -> DataFrame:
    """Relative strength, (r - 50) / 50."""
    w = ordered(keys, time)
    df = df.withColumn("__d", F.col(price) - F.lag(price).over(w))
    up = rolling(F.avg, F.when(F.col("__d").isNotNull(), F.greatest(F.col("__d"), F.lit(0.0))), n, least, w)
    down = rolling(F.avg, F.when(F.col("__d").isNotNull(), F.greatest(-F.col("__d"), F.lit(0.0))), n, least, w)
    df = df.withColumns({"__u": up, "__l": down})
    return df.withColumn(name, (F.try_divide(100.0 * F.col("__u"), F.col("__u") + F.col("__l")) - 50.0) / 50.0).drop("__d", "__u", "__l")


def ema(df: DataFrame, cols: dict[str, tuple[str, float]], keys: Sequence[str], time: Sequence[str]) -> DataFrame:
    """Exponential means y0 = x0, y = a x + (1 - a) y, a = 2 / (span + 1), as name: (column, span).

    Recursive in the row before, which no window frame expresses in linear time; one vectorised pass in
    Arrow batches over rows that are clustered by key and sorted by time. The mean so far of a batch's last
    key goes on as first value of the next batch, so a hot key is streamed and never held. A missing x
    keeps the mean.
    """
    out = df.select("*", *[F.lit(None).cast("double").alias(n) for n in cols])
    names = list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for pdf in batches:
            if not len(pdf):
                continue
            groups = pdf.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
            first, last = (tuple(pdf[k].iloc[i] for k in keys) for i in (0, -1))
            for name, (col, span) in cols.items():
                before = state.get(name, np.nan) if first == key else np.nan
                x = np.append(before, pdf[col].to_numpy(float))
                mean = pd.Series(x).groupby(np.append(groups[0], groups), sort=False).ewm(span=span, adjust=False, ignore_na=True).mean()
                y = mean.sort_index(level=-1).to_numpy()[1:]
                state[name] = y[-1]
                pdf[name] = y
            key = last
            yield pdf[names + list(cols)]

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *time)
    return dealt.mapInPandas(run, out.schema)


def add_beta(df: DataFrame, y: str, x: str, w: WindowSpec, n: int, least: int, name: str, bound: float = 5.0) -> DataFrame:
    """Rolling beta (mean(xy) - mean(x) mean(y)) / var_samp(x), each over its own values; bounded, lagged once."""
    product = F.col(y) * F.col(x)
    top = rolling(F.avg, product, n, least, w) - rolling(F.avg, y, n, least, w) * rolling(F.avg, x, n, least, w)
    df = df.withColumn("__b", clip(F.try_divide(top, F.nullif(rolling(F.var_samp, x, n, least, w), F.lit(0.0))), -bound, bound))
    return df.withColumn(name, F.lag("__b").over(w)).drop("__b")


def wealth(r: Column | str, w: WindowSpec) -> Column:
    """Running product of 1 + r; missing counts as 0, and a total loss ends in 0."""
    r = F.coalesce(_c(r), F.lit(0.0))
    frame = w.rowsBetween(START, NOW)
    broke = F.max((r <= -1).cast("int")).over(frame)
    return F.when(broke == 1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.when(r > -1, r).otherwise(0.0))).over(frame)))


def drawdown(value: Column | str, w: WindowSpec, base: float = 1.0) -> Column:
    """Value over its highest so far, less 1; `base` counts as an earlier value."""
    return _c(value) / F.greatest(F.max(_c(value)).over(w.rowsBetween(START, NOW)), F.lit(base)) - 1


def novelty(vector: Column | str, w: WindowSpec, n: int = 20) -> Column:
    """1 less the highest inner product with the n vectors before, within 0 and 1; NULL for the first."""
    before = F.collect_list(_c(vector)).over(w.rowsBetween(-n, -1))
    best = F.array_max(F.transform(before, lambda v: dot(v, _c(vector))))
    return F.when(F.size(before) > 0, clip(1 - best, 0.0, 1.0))


def sequence_window(cols: Sequence[str], w: WindowSpec, n: int = 30) -> Column:
    """The n rows before as an array of structs, NULL where there are fewer."""
    before = F.collect_list(F.struct(*cols)).over(w.rowsBetween(-n, -1))
    return F.when(F.size(before) == n, before)


def nth_last(df: DataFrame, k: int, keys: Sequence[str], time: str) -> DataFrame:
    """For each key its k-th last row."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == k).drop("__n")
