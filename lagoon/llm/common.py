"""What the training-data operators share: materialised tables, Arrow row streams, sized joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a dataset directory; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; on a local master without one a temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = os.path.join(tempfile.gettempdir(), "checkpoints")
        sc.setCheckpointDir(named)
        found = sc.getCheckpointDir()
    return found


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation of Python stages.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_slices(batches: Iterable[pa.RecordBatch], rows: int = 512, text: int | None = None, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most `rows` rows and, by column `text`, about `size` bytes.

    A single longer text is a slice of its own; nothing is dropped.
    """
    for batch in batches:
        n, at = batch.num_rows, 0
        if text is None:
            while at < n:
                yield batch.slice(at, rows)
                at += rows
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        while at < n:
            end, total = at, 0
            while end < n and end - at < rows and (end == at or total + lengths[end] <= size):
                total += lengths[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def keep_rows(docs: DataFrame, keys: DataFrame, key: str, most_rows: int = 500_000, anti: bool = False) -> DataFrame:
    """Semi (or anti) join of wide rows with a materialised table of distinct keys.

    The keys are broadcast if counting shows at most `most_rows` (8 bytes each); beyond that both
    sides are shuffled, and AQE splits hot partitions.
    """
    small = keys.limit(most_rows + 1).count() <= most_rows
    side = F.broadcast(keys) if small else keys.hint("merge")
    return docs.join(side, key, "left_anti" if anti else "left_semi")
