"""Queries over whole tables: rows of every key come back."""

import datetime as dt

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["p4_p18_projections", "j5_j6_next_session", "j16_bucketed_interval_join", "s6_json_shapes", "j23_full_outer_merge"])
def test_whole_queries_have_no_id_subset(name):
    assert not any(f in entry.oracle_sql()[name] for f in ("l_orderkey %", "o_orderkey %", "l_orderkey <", "event_id % 5"))


def test_whole_tables(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    run = lambda name: entry.queries()[name](spark, sf_dir)
    assert run("j5_j6_next_session").count() == run("s6_json_shapes").count() == li
    assert run("p4_p18_projections").count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity <> 25").count()
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = run("j23_full_outer_merge").selectExpr("sum(x) x", "sum(y) y").first()
    want = e.selectExpr("sum(if(event_id % 3 = 0, value, 0)) x", "count_if(event_id % 3 <> 0) y").first()
    assert got["y"] == want["y"] and got["x"] == pytest.approx(want["x"], abs=0.01)


def test_trees_predict_late_keys(spark, tmp_path):
    rows = [(k, 1, 1, float(k % 7 + 1), 0.01 * (k % 5), 100.0 + k, dt.datetime(1996 + k % 2, 6, 1)) for k in range(2900, 3100)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_discount double, l_extendedprice double, l_shipdate timestamp")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["l_orderkey"] for r in entry.queries()["m3_boosted_trees"](spark, str(tmp_path)).collect()}
    assert got == {k for k in range(2900, 3100) if k % 2}
