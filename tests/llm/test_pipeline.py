"""The pipeline's stages against brute force, and the registered names."""

import corpus_pipeline

import __spark_entry__ as entry
from lagoon.llm.common import keep_rows, row_slices


def test_registered():
    names = entry.queries().keys()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


def test_stages_keep_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    bench = [r["text"].lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = stage(spark, now, sf_dir).cache()
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.columns == docs.columns and after.items() <= before.items(), name
        gone = before.keys() - after.keys()
        if name == "toxicity":
            assert sum(labels.get(d) == 0 for d in gone) <= 0.05 * len(before)
        if name == "near_duplicates":
            assert len(set(after.values())) == len(after)
        if name == "decontamination":
            assert gone == {d for d, t in before.items() if any(b in t.lower() for b in bench)}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.collect()}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_slices_and_keep(spark):
    import pyarrow as pa

    b = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["t"])
    assert [x.num_rows for x in row_slices([b], rows=2, text=0, size=50)] == [2, 1, 2]
    df = spark.range(10)
    for most in (100, 1):
        assert keep_rows(df, df.where("id > 6"), "id", most).count() == 3 and keep_rows(df, df.where("id > 6"), "id", most, anti=True).count() == 7


AWKWARD = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, score string, part string"


def run_on(spark, tmp_path, rows, labels, bench):
    t = {"documents": (rows, AWKWARD), "labels": (labels, "doc_id bigint, quality int, toxic int"), "benchmark": (bench, "item_id bigint, text string")}
    for name, (some, kind) in t.items():
        spark.createDataFrame(some, kind).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def test_awkward_tables(spark, tmp_path):
    passage = "a passage of the benchmark that is told apart from all else by its words"
    extra = ("en", None, 1, "x", "x", "x", "x")
    calm = [f"calm{i} is what document {i} says about {i * 7} things of its own kind" for i in range(200)]
    rows = [(i, t, *extra) for i, t in enumerate(calm)]
    rows += [(300 + i, f"{t} you nasty scoundrel", *extra) for i, t in enumerate(calm[:60])]
    rows += [(500, calm[0], *extra), (501, None, *extra), (502, "", *extra), (None, "a text without an id", *extra), (503, f"before {passage} after", *extra), (504, "word and more " * 20_000, *extra), (1, calm[1], *extra), (None, calm[2], *extra)]
    labels = [(i, 1, 0) for i in range(200)] + [(300 + i, 1, 1) for i in range(60)] + [(None, 1, 1), (0, None, None), (1, 1, 0)]
    out = run_on(spark, tmp_path, rows, labels, [(1, passage), (2, None), (3, "")]).collect()
    left = {r["doc_id"] for r in out}
    # 502 has the fingerprint of 501, no text being an empty one; 300.. are toxic, 500 a copy of 0, 503 repeats the benchmark
    assert left >= {*range(200), 501, 504, None} and not left & {*range(300, 360), 500, 502, 503}
    assert sum(r["doc_id"] == 1 for r in out) == 1 and sum(r["doc_id"] is None for r in out) == 1
    assert len({(r["doc_id"], r["piece"]) for r in out}) == len(out)


def test_empty_tables(spark, tmp_path):
    assert run_on(spark, tmp_path, [], [], []).count() == 0
    rows = [(1, "one text of some words", "en", "s", 1, "x", "x", "x", "x")]
    assert run_on(spark, tmp_path, rows, [], []).count() == 1
