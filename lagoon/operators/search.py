"""Search: exact vector top-k, inverted index with BM25, reciprocal-rank fusion, hit merging and hydration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.exprs import dot
from lagoon.operators.text import words

#: BM25's usual constants, and that of reciprocal-rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def vector_top_k(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k rows of highest inner product with one query vector, ties to the smaller key.

    The filter (a date cutoff, say) is applied before scoring; top-k is taken per task and merged.
    """
    rows = df if where is None else df.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.col(vector).isNotNull()).select(key, dot(vector, q).alias("score"))
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def first_per_article(hits: DataFrame, chunk: str, article: str, n: int) -> DataFrame:
    """Of ranked chunks each article's best: (article, chunk, rank), n of them."""
    w = Window.orderBy(F.col("score").desc(), chunk)  # hits are a top-k, not a table
    ranked = hits.withColumn("rank", F.row_number().over(w))
    best = ranked.groupBy(article).agg(F.min_by(chunk, "rank").alias(chunk), F.min("rank").alias("rank"))
    return best.orderBy("rank").limit(n)


def postings(df: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """Inverted index: (term, key, tf, length) with each field's terms counted by its weight."""
    out = None
    for col, weight in fields.items():
        one = df.select(key, F.explode(words(col)).alias("term")).groupBy("term", key).agg((F.count(F.lit(1)) * weight).alias("tf"))
        out = one if out is None else out.unionByName(one)
    out = out.groupBy("term", key).agg(F.sum("tf").alias("tf"))
    length = out.groupBy(key).agg(F.sum("tf").alias("length"))
    return out.join(length, key)


def bm25(index: DataFrame, key: str, terms: Sequence[str], k: int) -> DataFrame:
    """The k documents that have all terms, by BM25; ties to the smaller key.

    The index is filtered to the query's terms before anything else; document counts and mean length
    come from one aggregation over it.
    """
    want = sorted({t.lower() for t in terms})
    stats = index.groupBy(key).agg(F.first("length").alias("l")).agg(F.count(F.lit(1)).alias("n"), F.avg("l").alias("mean"))
    hit = index.where(F.col("term").isin(want))
    df_ = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = hit.join(F.broadcast(df_), "term").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    s = x.groupBy(key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("m")).where(F.col("m") == len(want))
    return s.select(key, "score").orderBy(F.col("score").desc(), key).limit(k)


def fuse(left: DataFrame, right: DataFrame, key: str, n: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (key, rank); score 1 for first in both."""
    a, b = left.select(key, F.col("rank").alias("__a")), right.select(key, F.col("rank").alias("__b"))
    both = a.join(b, key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", (part("__a") + part("__b")) / (2.0 / (k + 1)))
    both = both.withColumn("branch", F.when(F.coalesce("__a", F.lit(1 << 30)) <= F.coalesce("__b", F.lit(1 << 30)), "left").otherwise("right"))
    return both.select(key, "score", "branch").orderBy(F.col("score").desc(), key).limit(n)


def merge_hits(lists: Sequence[DataFrame], order: str, key: Sequence[str], n: int, exclude: DataFrame | None = None, exclude_key: str | None = None) -> DataFrame:
    """Hits of several sources, the best of each key, without excluded ones, n of them."""
    out = None
    for i, hits in enumerate(lists):
        hits = hits.withColumn("source_list", F.lit(i))
        out = hits if out is None else out.unionByName(hits)
    if exclude is not None:
        out = out.join(exclude.select(exclude_key), exclude_key, "left_anti")
    w = Window.partitionBy(*key).orderBy(F.col(order).desc(), "source_list")
    best = out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return best.orderBy(F.col(order).desc(), *key).limit(n)


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """A list's places by score."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))
