"""Linear models from Gram matrices, walk-forward prediction, scaling and metrics.

A ridge fit needs sums of products only. They are aggregated per fold in one pass over the table; folds and
penalties are then solved on the driver from matrices of the number of features, never from rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(df: DataFrame, fold: str, features: Sequence[str], target: str, weight: str | None = None) -> dict[object, np.ndarray]:
    """Fold to the matrix of weighted sums of products of (1, features, target); missing features count as 0.

    Each Arrow batch gives one matrix per fold it holds, and those are summed by Spark.
    """
    width = len(features) + 2
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)]
    slim = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull()).select(F.col(fold).alias("fold"), *cols, F.col(target).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, g in pdf.groupby("fold"):
                x = np.column_stack([np.ones(len(g)), g.drop(columns=["fold", "w"]).to_numpy(float)])
                m = (x * g["w"].to_numpy(float)[:, None]).T @ x
                yield pd.DataFrame({"fold": k, "i": np.arange(width * width), "s": m.ravel()})

    kind = slim.schema["fold"].dataType.simpleString()
    sums = slim.mapInPandas(partial, f"fold {kind}, i int, s double").groupBy("fold", "i").agg(F.sum("s").alias("s"))
    out: dict[object, np.ndarray] = {}
    for r in sums.collect():  # folds x width^2 numbers
        out.setdefault(r["fold"], np.zeros(width * width))[r["i"]] = r["s"]
    return {k: v.reshape(width, width) for k, v in out.items()}


def solve_ridge(gram: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept (unpenalised) and coefficients."""
    n, sx, sy = gram[0, 0], gram[0, 1:-1], gram[0, -1]
    xx = gram[1:-1, 1:-1] - np.outer(sx, sx) / n
    xy = gram[1:-1, -1] - sx * sy / n
    beta = np.linalg.solve(xx + alpha * np.eye(len(sx)), xy) if len(sx) else np.empty(0)
    return float((sy - sx @ beta) / n), beta


def linear_score(features: Sequence[str], intercept: float, beta: np.ndarray) -> Column:
    out = F.lit(float(intercept))
    for f, b in zip(features, beta, strict=True):
        out = out + F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.lit(float(b))
    return out


def walk_forward(df: DataFrame, year: str, label_end: str, features: Sequence[str], target: str, years: Sequence[int], span: int, alpha: float, weight: str | None = None) -> DataFrame:
    """Rows of each year with a prediction of a ridge fit on the `span` years before.

    Purged: a training row whose label ends in or after the predicted year is left out. One pass collects
    Gram matrices by (year, year in which the label ends), from which every fold is put together.
    """
    d = df.withColumn("__fold", F.col(year) * 10000 + F.year(label_end))
    by = grams(d.where(F.col(label_end).isNotNull()), "__fold", features, target, weight)
    score = None
    for y in years:
        some = [g for k, g in by.items() if y - span <= k // 10000 < y and k % 10000 < y]
        if not some or sum(g[0, 0] for g in some) <= len(features):
            continue
        s = linear_score(features, *solve_ridge(sum(some), alpha))
        score = F.when(F.col(year) == y, s) if score is None else score.when(F.col(year) == y, s)
    return df.where(F.col(year).isin(list(years))).withColumn("prediction", score if score is not None else F.lit(None).cast("double"))


def cross_fitted(df: DataFrame, year: str, label_end: str, features: Sequence[str], target: str, years: Sequence[int], alpha: float, active: Column, known: DataFrame | None = None) -> DataFrame:
    """Out-of-fold predictions of the active rows of each year, by a fit on all rows of years before.

    Purged as in `walk_forward`; training takes inactive rows too. Years that `known` (an earlier result with
    the same columns) covers are taken from there and not fitted again. A year without a fit or without
    active rows is an error.
    """
    done = {r[0] for r in known.select(year).distinct().collect()} & set(years) if known is not None else set()  # as many as folds
    wanted = [y for y in years if y not in done]
    out = walk_forward(df, year, label_end, features, target, wanted, 10**6, alpha).where(active)
    found = {r[0]: r[1] for r in out.groupBy(year).agg(F.count("prediction")).collect()}
    if missing := [y for y in wanted if not found.get(y)]:
        raise ValueError(f"no training rows or no active rows for {missing}")
    return out if known is None else out.unionByName(known.where(F.col(year).isin([*done])).select(*out.columns))


def choose_alpha(df: DataFrame, fold: str, train: Sequence, valid: Sequence, features: Sequence[str], target: str, alphas: Sequence[float]) -> list[tuple[float, float]]:
    """(mean squared error, alpha) on the validation folds, best first; from Gram matrices, so the grid costs no pass."""
    by = grams(df, fold, features, target)
    fit, test = sum(by[k] for k in train if k in by), sum(by[k] for k in valid if k in by)
    out = []
    for a in alphas:
        b0, b = solve_ridge(fit, a)
        v = np.concatenate([[b0], b, [-1.0]])
        out.append((float(v @ test @ v / test[0, 0]), a))
    return sorted(out)


def standardised(df: DataFrame, train: Column, cols: Sequence[str]) -> DataFrame:
    """Columns scaled by the mean and population deviation of the training rows; constants become 0."""
    stats = df.where(train).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    out = df.join(F.broadcast(stats))
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))), F.lit(0.0)) for c in cols}
    return out.withColumns(scaled).select(*df.columns)


def boosted_trees(train: DataFrame, features: Sequence[str], target: str, trees: int = 20, depth: int = 4, seed: int = 7):
    """A gradient-boosted regression of the ML library."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep"), GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="prediction", maxIter=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(train)
