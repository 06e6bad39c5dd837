import datetime as dt
import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagoon.operators import aliases, fundamentals, ingest, macro, models, portfolio, select


def test_replay_against_a_loop(spark):
    rng = random.Random(1)
    rows = {(k, o, t): float(rng.randint(0, 99)) for k in "ab" for o in range(12) for t in range(20) if rng.random() < 0.2}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()] + [("a", 3, 4, None), (None, 1, 1, 1.0)], "s string, o int, t int, v double")
    got = {(r["s"], r["t"]): r[2:] for r in ingest.vintage_replay(df, "s", "o", "t", "v").collect()}
    want = {}
    for k in "ab":
        state, before = {}, None
        for t in sorted({t for s, _, t in rows if s == k}):
            new = {o: v for (s, o, at), v in rows.items() if s == k and at == t}
            steps = [v - state[o] for o, v in new.items() if o in state]
            state |= new
            first, *rest = sorted(state, reverse=True)
            want[k, t] = (first, state[first], state[first] - state[rest[0]] if rest else None, None if before is None else state[first] - before, sum(steps) / len(steps) if steps else 0.0)
            before = state[first]
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    assert ingest.vintage_replay(df.limit(0), "s", "o", "t", "v").count() == 0


def test_facts_nearest_the_report_win(spark):
    d = dt.date
    at = dt.datetime(2024, 5, 1, 12)
    filings = spark.createDataFrame([("a1", 7, "10-Q", d(2024, 3, 31), at, "accepted"), ("a2", 7, "8-K", d(2024, 3, 31), at, "accepted"), ("a3", 7, "10-K", None, None, "accepted")], "accession string, cik int, form string, report_date date, accepted_at timestamp, available_at_quality string")
    kind = "accession string, tag string, unit string, period_start date, period_end date, value double, fiscal_year int, fiscal_period string, available_at timestamp"
    facts = [
        ("a1", "Revenues", "USD", d(2024, 1, 1), d(2024, 3, 31), 10.0, 2024, "Q1", at),
        ("a1", "Revenues", "USD", d(2023, 4, 1), d(2024, 3, 31), 44.0, 2024, "Q1", at),  # a year, not a quarter
        ("a1", "SalesRevenueNet", "USD", d(2024, 1, 1), d(2024, 3, 31), 11.0, 2024, "Q1", at),  # a later tag
        ("a1", "Revenues", "USD", d(2023, 1, 1), d(2023, 3, 31), 9.0, 2023, "Q1", at),  # a comparison
        ("a1", "Assets", "USD", None, d(2024, 3, 31), 100.0, 2024, "Q1", at),
        ("a1", "Assets", "shares", None, d(2024, 3, 31), 5.0, 2024, "Q1", at),
        ("a1", "GrossProfit", "USD", d(2024, 1, 1), d(2024, 3, 31), None, 2024, "Q1", at),
        ("a2", "Assets", "USD", None, d(2024, 3, 31), 1.0, 2024, "Q1", at),
    ]
    chosen = fundamentals.chosen_facts(spark.createDataFrame(facts, kind), filings)
    (r,) = chosen.collect()
    assert {m: p["value"] for m, p in r["picks"].items()} == {"revenue": 10.0, "assets": 100.0}
    (f,) = fundamentals.fundamental_features(chosen).collect()
    assert len(fundamentals.FEATURES) == 41 and f["annualized_asset_turnover"] == pytest.approx(0.4) and f["debt_to_assets"] == 0.0
    assert f["gross_margin"] is None and f["fundamental_field_coverage"] == pytest.approx(2 / 32) and f["filing_is_annual"] == 0.0
    days = spark.createDataFrame([(d(2024, 5, 1),), (d(2024, 5, 2),), (d(2024, 5, 3),)], "day date")
    who = spark.createDataFrame([("X", 7), ("Y", 7), ("Z", 8)], "ticker string, cik int")
    got = {x["ticker"]: x["trade_date"] for x in fundamentals.filing_snapshots(fundamentals.fundamental_features(chosen), who, days, "day").collect()}
    assert got == {"X": d(2024, 5, 2), "Y": d(2024, 5, 2)}
    assert fundamentals.fundamental_features(fundamentals.chosen_facts(spark.createDataFrame([], kind), filings.limit(0))).count() == 0


def test_impulse_wears_off(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, i),) for i in range(1, 8)], "day date")
    e = spark.createDataFrame([("S", dt.date(2024, 1, 2), 1.5, 2.0), ("S", dt.date(2024, 1, 1), 9.0, 9.0), ("S", dt.date(2024, 1, 4), None, -1.0), ("T", dt.date(2024, 1, 7), 1.0, 1.0)], "s string, t date, regime_z double, impulse_z double")
    out = macro.macro_columns(macro.macro_features(e, "s", "t", days, "day", 2.0), "s", ["S"]).orderBy("trade_date").collect()
    assert [r["macro__s__regime_z"] for r in out] == [0.0, 9.0, 1.5, 1.5, 1.5, 1.5, 1.5]
    assert [r["macro__s__impulse_z"] for r in out] == pytest.approx([0.0, 9.0, 2.0, 2.0 * math.exp(-0.5), -1.0, -math.exp(-0.5), -math.exp(-1.0)])


def _prices(spark, closes, opens=None):
    rows = [(dt.date(2024, 1, 1 + i), k, (opens or closes)[k][i], c) for k in closes for i, c in enumerate(closes[k]) if c is not None]
    return spark.createDataFrame(rows, "d date, k string, open double, close double")


def test_backtest_modes_thresholds_and_errors(spark):
    names = [f"n{i:02d}" for i in range(20)]
    p = _prices(spark, {k: [10.0, 11.0 if k == "n19" else None if k == "n00" else 10.0, 12.0 if k == "n19" else 9.0 if k == "n00" else 10.0] for k in names})
    pred = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 3), k, float(i)) for i, k in enumerate(names)], "d date, e date, k string, s double")
    run = lambda **kw: portfolio.backtest(pred, p, "d", "e", "k", "s", **({"horizon": 2, "fraction": 0.05} | kw)).orderBy("d").collect()
    both = run()
    assert [r["nav"] for r in both] == pytest.approx([1.0, 1.0 + 0.25 * 0.1, 1.0 + 0.25 * 0.2 + 0.25 * 0.1])  # the short is marked at its last close first
    assert [(r["cohorts"], r["long_names"], r["short_names"], r["signal"]) for r in both] == [(1, 1, 1, True), (1, 0, 0, False), (0, 0, 0, False)]
    assert both[0]["gross"] == pytest.approx(0.5) and both[0]["net"] == pytest.approx(0.0)
    assert [r["nav"] for r in run(mode="long-only")] == pytest.approx([1.0, 1.05, 1.1])
    assert run(mode="long-only", cost_bps=10.0)[-1]["nav"] == pytest.approx(1.1 - 0.5 * 0.001 - 0.6 * 0.001)
    assert run(mode="long-only", long_z=1.2)[0]["long_names"] == 1 and run(long_z=1.2, short_z=9.0)[-1]["nav"] == 1.0  # one side alone is no signal
    for bad in ({"mode": "short"}, {"horizon": 0}, {"fraction": 0.5}, {"long_z": 1.0}, {"long_z": -1.0, "short_z": 1.0}):
        with pytest.raises(ValueError):
            run(**bad)
    with pytest.raises(Exception, match="fewer than 21 names"):
        run(least_names=21)


def test_cross_fits_reuse_known_years(spark):
    rng = random.Random(2)
    rows = [(y, dt.date(y, 6, 1), float(x := rng.gauss(0, 1)), 2.0 * x, i % 2 == 0) for y in range(2000, 2004) for i in range(30)]
    df = spark.createDataFrame(rows, "y int, e date, x double, t double, on boolean")
    fit = models.cross_fitted(df, "y", "e", ["x"], "t", [2002, 2003], 1e-6, F.col("on"))
    assert fit.count() == 30 and all(r["prediction"] == pytest.approx(r["t"], abs=1e-3) for r in fit.collect())
    known = fit.where("y = 2002").withColumn("prediction", F.lit(5.0))
    again = models.cross_fitted(df, "y", "e", ["x"], "t", [2002, 2003], 1e-6, F.col("on"), known).collect()
    assert len(again) == 30 and {r["prediction"] for r in again if r["y"] == 2002} == {5.0}
    with pytest.raises(ValueError, match="2000"):
        models.cross_fitted(df, "y", "e", ["x"], "t", [2000], 1.0, F.col("on"))


def test_balanced_selection_against_a_loop(spark):
    rng = random.Random(3)
    rows = [("train" if i % 3 else "test", i, f"k{rng.randint(0, 5)}", str(2000 + rng.randint(0, 4)), rng.choice(["A", "B", None]), float(rng.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "split string, id int, k string, y string, g string, s double")
    got = {}
    for r in select.quota_balanced(df, "split", "s", ["id"], "k", "y", "g", 40).collect():
        got.setdefault(r["split"], set()).add((r["id"], r["reason"]))
    for split in ("train", "test"):
        mine = sorted((r for r in rows if r[0] == split), key=lambda r: (-r[5], r[1]))
        n, first = 40, 28
        cap = {2: max(2, math.ceil(first / len({r[2] for r in mine}) * 3)), 3: max(2, math.ceil(first / len({r[3] for r in mine}) * 2))}
        used, best = Counter(), []
        for r in mine:
            if len(best) < first and all(used[c, r[c]] < cap[c] for c in cap):
                best.append(r)
                used.update((c, r[c]) for c in cap)
        queues = {}
        for r in mine:
            if r not in best:
                queues.setdefault((r[3], r[4] or "Unknown"), []).append(r)
        dealt = []
        while len(best) + len(dealt) < n and any(queues.values()):
            for g in sorted(queues):
                if queues[g] and len(best) + len(dealt) < n:
                    dealt.append(queues[g].pop(0))
        assert got[split] == {(r[1], "high_importance") for r in best} | {(r[1], "balanced_coverage") for r in dealt}
    assert select.quota_balanced(df, "split", "s", ["id"], "k", "y", "g", 0).count() == 0


def test_aliases(spark):
    rows = [("A", '{"name": " Acme Corp ", "formerNames": [{"name": "Old", "from": "1999-01-02T00:00:00Z", "to": "2005-03-04T00:00:00Z"}, {"name": "", "to": "2010-01-01"}]}', "2024-01-01"), ("B", '{"name": "Bee"}', "2024-01-01T09:00:00Z"), ("C", "no json", "2024-01-01"), ("D", None, None)]
    got = {(r["ticker"], r["alias"]): (r["valid_from"], r["valid_to"]) for r in aliases.registrant_aliases(spark.createDataFrame(rows, "t string, p string, r string"), "t", "p", "r").collect()}
    d = dt.date
    assert got == {("A", "Old"): (d(1999, 1, 2), d(2005, 3, 4)), ("A", "Acme Corp"): (d(2005, 3, 5), None), ("B", "Bee"): (d(2024, 1, 1), None)}
    ok = spark.createDataFrame([(" ab ", "Thing", "Product", "2020-01-01")], "ticker string, alias string, alias_kind string, valid_from string")
    (r,) = aliases.curated_aliases(ok).collect()
    assert (r["ticker"], r["alias_kind"], r["valid_from"], r["source"], r["confidence"]) == ("AB", "product", d(2020, 1, 1), "curated", 1.0)
    for bad, why in ((("x", "", "name", ""), "incomplete"), (("x", "y", "brand", None), "valid_from")):
        with pytest.raises(Exception, match=why):
            aliases.curated_aliases(spark.createDataFrame([bad], "ticker string, alias string, alias_kind string, valid_from string")).collect()
    with pytest.raises(ValueError):
        aliases.curated_aliases(ok.drop("alias"))


def test_surprise_fills_empty_sessions(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, i),) for i in range(1, 11)], "day date")
    e = pd.DataFrame([(dt.date(2024, 1, 1 + i % 8), "war", 1.0, 0.5, 2.0) for i in range(20)], columns=["d", "c", "i", "t", "v"])
    out = macro.news_surprise(spark.createDataFrame(e, "d date, c string, i double, t double, v double"), "d", "c", ["War".lower(), "peace"], "i", "t", "v", days, "day", 5, 2).collect()
    assert len(out) == 10 and all(v is not None for r in out for v in r) and {r["context__geo__event_count__peace__surprise"] for r in out} == {0.0}


def test_objects_of_awkward_payloads(spark):
    rows = [(1, '{"q": [{"a": "1,000", "d": "2024-01-02"}, {"a": "None"}, {"a": "x", "d": "soon"}]}'), (2, '{"q": []}'), (3, "no json"), (4, None), (5, '{"p": 1}')]
    got = ingest.object_rows(spark.createDataFrame([(*r, "2024-03-04 05:06:07") for r in rows], "k int, p string, at string"), "k", "p", "q", ["a"], ["d"], "at", "d").orderBy("place").collect()
    later = dt.datetime(2024, 3, 4, 5, 6, 7)
    assert [tuple(r) for r in got] == [(1, 0, 1000.0, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 23, 59, 59)), (1, 1, None, None, later), (1, 2, None, None, later)]


def test_backtest_of_nothing(spark):
    p = _prices(spark, {"a": [1.0, 2.0]})
    none = spark.createDataFrame([], "d date, e date, k string, s double")
    assert portfolio.backtest(none, p, "d", "e", "k", "s").count() == 0
