"""Exact top-k inner-product search by pivot-table elimination.

Distances of every vector to a few pivots bound its distance to a query from below (the largest
difference over the pivots), and with the norms its inner product from above. Candidates are evaluated
in the order of that bound until it falls under the k-th best score; what is left cannot enter.
Queries go through the table in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.common import materialise

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(lists: pa.Array, width: int | None, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, one row a vector; zeros up to `width`, and nothing beyond it."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64) * scale)
    width = int(size.max(initial=0)) if width is None else width
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(flat)) - np.repeat(start, size)
    out[row[col < width], col[col < width]] = flat[col < width]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of each row of x with q, as int64; saturated beyond its range."""
    largest = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, len(q))
    if largest < 2**53:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([min(max(s, LONG_MIN), LONG_MAX) for s in exact], np.int64)


@dataclass
class Block:
    """Queries with their distances to the pivots and a score that k rows are known to reach."""

    number: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    pivots: np.ndarray
    distances: np.ndarray
    floor: np.ndarray

    @staticmethod
    def build(number: np.ndarray, ids: np.ndarray, vectors: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, pivots: int, k: int) -> Block:
        sample = _fit(sample, vectors.shape[1])
        chosen = spread_out(sample, pivots)
        floor = np.full(len(ids), LONG_MIN, np.int64)
        for i, q in enumerate(vectors):
            s = products(q, sample)[sample_ids != ids[i]]
            if len(s) >= k:
                floor[i] = np.partition(s, len(s) - k)[len(s) - k]
        return Block(number, ids, vectors, chosen, distance(vectors, chosen), floor)

    def best(self, ids: np.ndarray, x: np.ndarray, k: int, step: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its k best of these candidates that reach its floor: (query, ids, scores)."""
        to_pivot = distance(x, self.pivots)
        norm = np.einsum("ij,ij->i", x, x)
        for i, q in enumerate(self.vectors):
            under = np.abs(to_pivot - self.distances[i]).max(axis=1, initial=0.0)
            # rounding of the distances may not lower a bound
            bound = (norm + q @ q - under * under) / 2
            bound += 1.0 + 1e-9 * (norm + q @ q)
            bound[~np.isfinite(bound)] = np.inf
            bound = np.maximum(bound, LONG_MIN)  # no saturated score is lower
            left = np.flatnonzero((bound >= self.floor[i]) & (ids != self.ids[i]))
            left = left[np.argsort(-bound[left], kind="stable")]
            kept_ids, kept = np.empty(0, np.int64), np.empty(0, np.int64)
            least, at = self.floor[i], 0
            while at < len(left) and bound[left[at]] >= least:
                some = left[at : at + step]
                score = products(q, x[some])
                good = score >= least
                kept_ids, kept = np.concatenate([kept_ids, ids[some[good]]]), np.concatenate([kept, score[good]])
                if len(kept) > k:
                    order = np.lexsort((kept_ids, -kept))[:k]
                    kept_ids, kept = kept_ids[order], kept[order]
                if len(kept) == k:
                    least = max(least, kept.min())
                at += step
                step = min(2 * step, 4096)
            step = 64
            if len(kept):
                yield i, kept_ids, kept


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x), width))
    out[:, : min(width, x.shape[1])] = x[:, :width]
    return out


def distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(p)))
    for j, row in enumerate(p):
        d = x - row
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the farthest from those chosen before."""
    if not len(sample):
        return sample
    chosen, far = [0], distance(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distance(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, pivots: int = 16, query_block: int = 4096, sample_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of `vectors` with the highest inner product for each row of `queries`.

    Columns: query_id, rank (from 1), the id, score (long). Components are floor(scale * x). A query's
    own id is no candidate; ties go to the smaller id; fewer than k candidates give fewer rows. Null
    vectors and those with a null or non-finite component, and null ids, take no part. Vectors of unlike
    lengths are taken as if zeros followed; an empty vector scores 0. Repeated candidate rows count each;
    equal query rows are answered once. Scores beyond a long are saturated. Empty tables give an empty
    result; other columns are not read.

    Queries go to the executors in blocks of `query_block`, each against all vectors. A bounded sample of
    `sample_rows` vectors gives the pivots and, for each query, a first score to beat, so that a task
    returns few rows; it does not change the result.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable("v")).distinct()
    sample = slim.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    sample_ids, sample_x = sample.column(0).to_numpy(), quantised(sample.column(1), None, scale)

    parts = []
    for number, (ids, lists) in enumerate(_blocks(asked, query_block)):
        q = quantised(lists, None, scale)
        block = spark.sparkContext.broadcast(Block.build(np.arange(len(ids)) + number * query_block, ids, q, sample_ids, sample_x, pivots, k))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            b = block.value
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), quantised(batch.column(1), b.vectors.shape[1], scale)
                found = list(b.best(ids, x, k))
                if found:
                    many = [len(s) for _, _, s in found]
                    which = np.repeat([i for i, _, _ in found], many)
                    yield pa.record_batch([pa.array(b.number[which]), pa.array(b.ids[which]), pa.array(np.concatenate([c for _, c, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], names=["number", "query_id", "id", "score"])

        parts.append(materialise(slim.mapInArrow(run, "number bigint, query_id bigint, id bigint, score bigint")))
        block.destroy()
    if not parts:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _blocks(asked: DataFrame, size: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The queries, `size` at a time on the driver."""
    kind = pa.list_(pa.float64())
    ids: list[int] = []
    lists: list[list[float]] = []
    for row in asked.toLocalIterator():
        ids.append(row["id"])
        lists.append(row["v"])
        if len(ids) == size:
            yield np.array(ids, np.int64), pa.array(lists, kind)
            ids, lists = [], []
    if ids:
        yield np.array(ids, np.int64), pa.array(lists, kind)
