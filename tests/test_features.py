"""Builders, records and gates: errors, leakage and edge cases beyond the queries' SQL."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lagoon.operators import evaluate, features, panel, records


def prices(spark, change_last=False):
    rng = random.Random(3)
    rows = []
    for e in range(4):
        for i in range(40):
            o = 10 + rng.random() * 5
            c = o * (1 + rng.uniform(-0.02, 0.02))
            if change_last and i == 39:
                o, c = 99.0, 1.0
            rows.append((e, dt.date(2024, 1, 1) + dt.timedelta(days=i), o, max(o, c) + 1, min(o, c) - 1, c, 100.0 + rng.randrange(50)))
    return spark.createDataFrame(rows, "entity int, d date, open double, high double, low double, close double, volume double")


def framed(spark, p, horizon=1):
    dim = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "entity int, sector string")
    market = p.groupBy("d").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    return features.training_frame(p, dim, market, steps=(1, 5), horizon=horizon)


def test_training_frame_looks_back_only(spark):
    before, names = framed(spark, prices(spark))
    after, _ = framed(spark, prices(spark, change_last=True))
    assert len(names) == 2 * 20 + 1 and {r["entity"] for r in before.select("entity").distinct().collect()} == {0, 1, 2}
    rows = lambda f: {(r["entity"], r["d"]): [r[n] for n in names] for r in f.collect()}
    a, b = rows(before), rows(after)
    assert a.keys() == b.keys() and all(repr(a[k]) == repr(b[k]) for k in a)
    three, _ = framed(spark, prices(spark), 3)
    assert three.where("date_diff(target_end, d) <> 2").count() == 0 and three.count() == 3 * 38
    with pytest.raises(ValueError):
        framed(spark, prices(spark), 0)


def test_ema_over_batches(spark):
    rng = random.Random(5)
    rows = [(k, i, None if rng.random() < 0.2 else rng.random()) for k in ("a", None, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = {(r["k"], r["i"]): r["y"] for r in panel.ema(df, {"y": ("x", 5)}, ["k"], ["i"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for k in ("a", None, "b"):
        y = None
        for _, i, x in (r for r in rows if r[0] == k):
            y = y if x is None else x if y is None else x / 3 + y * 2 / 3
            assert got[k, i] == pytest.approx(y) if y is not None else got[k, i] is None or got[k, i] != got[k, i]


def test_immutable_rows(spark):
    kind = "k int, at int, born string, text string"
    old = spark.createDataFrame([(1, 5, "x", "first"), (3, 1, None, "c")], kind)
    new = spark.createDataFrame([(1, 1, "x", "later prose"), (2, 2, "y", "b"), (3, 9, None, "d")], kind)
    got = records.immutable_upsert(old, new, "k", "at", ["born"], ["text"])
    assert sorted(r["text"] for r in got.collect()) == ["b", "c", "first"]
    bad = spark.createDataFrame([(1, 9, "z", "")], kind)
    with pytest.raises(Exception, match="changed fixed columns of 1"):
        records.immutable_upsert(old, bad, "k", "at", ["born"], ["text"]).collect()


def test_gates_and_contracts(spark):
    df = spark.createDataFrame([(i,) for i in range(90)], "k int")
    all_ = spark.range(100).select(F.col("id").cast("int").alias("k"))
    with pytest.raises(features.CoverageError):
        features.coverage_gate(df, all_, "k")
    assert features.coverage_gate(df, all_, "k", 0.9).count() == 90
    records.check_contract({"a": 1, "b": 0.1}, {"a": 1, "b": 0.1 + 1e-15})
    with pytest.raises(records.ConflictError, match="'a', 'c'"):
        records.check_contract({"a": 1, "b": 2}, {"a": 2, "b": 2, "c": 3})
    assert records.feature_set({"q": ["x", "y"], "n": ["y", "z"]}, "q+n") == ["x", "y", "z"]
    with pytest.raises(ValueError):
        records.feature_set({"q": []}, "q+w")
    assert records.parse_series("A=Alpha, B, C = see") == {"A": "Alpha", "B": "B", "C": "see"}


def test_annual_ic_and_daily_scores(spark):
    rng = random.Random(7)
    rows = [(dt.date(2020 + d // 30, 1 + d % 12, 1 + d % 28), k, rng.random(), rng.random()) for d in range(60) for k in range(25)]
    df = spark.createDataFrame(rows, "d date, k int, p double, t double")
    daily = evaluate.daily_scores(df, "d", "p", "t", "k")
    years = evaluate.annual_ic(daily, "d", 3)
    assert [y["year"] for y in years] == [2020, 2021] and all(0 <= y["p"] <= 1 and y["days"] > 10 for y in years)
    flat = evaluate.daily_scores(df.withColumn("p", F.lit(1.0)), "d", "p", "t", "k")
    assert flat.where("ic is not null").count() == 0 and evaluate.daily_scores(df.limit(0), "d", "p", "t", "k").count() == 0
