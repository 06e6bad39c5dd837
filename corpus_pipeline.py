"""The corpus pipeline: toxicity, near-duplicates, benchmark overlaps, packing.

Each stage works on what its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lagoon.llm.common import materialise, table
from lagoon.llm.decontaminate import drop_contaminated
from lagoon.llm.packing import pack
from lagoon.llm.simhash import drop_near_duplicates
from lagoon.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the lexicon is learned from the labelled ones among them."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark passage."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: No SQL: scores, XXH64 votes, alignments and packing are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the shared folder and read again.

    Null and empty texts are texts without words: they are not toxic, are near-duplicates of each other and
    pack as an end mark. Of rows that repeat an id one stays. Rows without an id stay unless a row with one
    has a near text. Empty documents give an empty result; without labels of both classes nothing is
    toxic; without a benchmark nothing is dropped for it. Further columns of documents go along to the
    last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, compression="zstd")
    return docs
