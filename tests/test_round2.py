"""Queries against their SQL on small tables that the driver's do not hold, and operators at odd sizes."""

import datetime as dt
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lagoon.operators import events, joins


def both(spark, folder, name, tables):
    """Sorted rows of a query and of its SQL over these tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_assessments_without_confidence(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(0, at, 1, "view", 0.0), (1, at, 2, "view", 0.0), (2, at, 2, "click", 80.0), (3, at, 2, None, 30.0), (4, at + dt.timedelta(1), 1, "view", 7.5)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    got, want = both(spark, tmp_path, "a9_a11_assessments", {"events": e})
    assert got == want and len(got) == 2


def test_containment_shuffles_no_texts(spark):
    rows = [(1, "Under the MIT License, or the MIT-License."), (2, "the mit licenses"), (2, "A license"), (3, None), (4, ""), (5, "the the MIT license")]
    t = spark.createDataFrame(rows, "id long, text string")
    a = spark.createDataFrame([("The MIT license",), ("the mit",), ("license",), ("--",), ("or",), (None,)], "alias string")
    want = [(1, "The MIT license"), (1, "license"), (1, "or"), (1, "the mit"), (2, "license"), (2, "the mit"), (5, "The MIT license"), (5, "license"), (5, "the mit")]
    for most in (1000, 2):
        hit = joins.containment_join(t, "text", a, "alias", ["id"], most).select("id", "alias")
        assert sorted(map(tuple, hit.collect())) == want
    plan = joins.containment_join(t, "text", a, "alias", ["id"]).select("id", "alias")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert joins.containment_join(t, "text", a.where(F.lit(False)), "alias", ["id"]).count() == 0


def test_clusters_by_a_forest_of_links(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (70, 8))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, f"g{i % 2}", [float(x) for x in np.float32(base[i % 70])]) for i in range(140)]
    rows += [(200, "g0", [0.6, 0.5, *[0.0] * 6]), (201, "g2", [0.3] + [0.0] * 7), (202, "g2", [1.0] + [0.0] * 7), (203, "g2", [0.0] * 8)]
    e = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got, want = both(spark, tmp_path, "x20_clusters", {"embeddings": e})
    assert got == want
    pairs = joins.similarity_pairs(e, "vec_id", "label", "embedding", None, 0.3)
    for bucket in (3, 2048):
        links = joins.similarity_forest(e, "vec_id", "label", "embedding", 0.3, bucket)
        roots = [events.connected_components(e.select("vec_id"), x, "vec_id").collect() for x in (pairs, links)]
        assert sorted(roots[0]) == sorted(roots[1])
    assert links.count() < 2 * e.count() < pairs.count()
    odd = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0]), (3, "a", None), (4, "a", [1.0, None]), (5, None, [1.0, 0.0]), (6, "a", [1.0, 0.0]), (7, "a", [float("nan"), 0.0])], "k int, g string, v array<double>")
    assert {tuple(sorted(r)) for r in joins.similarity_forest(odd, "k", "g", "v", 2.0).collect()} == {(1, 7), (6, 7)}  # NaN is above every bound
    assert joins.similarity_forest(odd.where("k = 2"), "k", "g", "v", 0.5).count() == 0


def test_a_tile_of_copies_takes_few_links():
    left, right = joins.spanning_links(np.ones((900, 4)), np.ones((800, 4)), 0.5)
    assert len(left) == len(right) == 900 + 800 - 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_assessment_features_round_ties_up(spark, tmp_path):
    exact = {(49, 1996): 0.239063, (305, 2000): 0.260313, (566, 1995): 0.285938, (869, 1996): 0.273438}  # ties, by decimals
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where(F.col("l_suppkey").isin(49, 305, 566, 869))
    for n, order in enumerate(("l_orderkey", "l_tax", "l_quantity")):
        li.coalesce(1).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        made = entry.queries()["a10_assessment_features"](spark, f"{tmp_path}/{n}").collect()
        assert {(r["k"], r["y"]): r["persistence"] for r in made if (r["k"], r["y"]) in exact} == exact


def test_word_cache_looks_a_word_up_once():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from lagoon.llm.packing import WordCache

    texts = ["one two, one", "", "two three four two", "one <|x|> five. one"]
    for most in (2, 1000):
        cache = WordCache(public_tokenizers.path("word_bpe_49k.json"), most)
        want = [np.array(cache.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert cache.ids(texts) == want and not cache.known.new
        missed = cache.known.missed
        assert cache.ids(texts) == want and (cache.known.missed > missed) == (most == 2)
