"""Writers: committed tables, partition replacement, compressed CSV, index builds with a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet through the commit protocol: readers see all of it or none."""
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Only the partitions that `df` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str, compression: str = "gzip", digits: int | None = None) -> None:
    """CSV parts with a header each; doubles with so many significant digits, if said."""
    if digits is not None:
        df = df.withColumns({c: F.format_string(f"%.{digits}g", c) for c, t in df.dtypes if t in ("double", "float")})
    df.write.mode("overwrite").csv(path, header=True, compression=compression)


def write_index(spark: SparkSession, postings: DataFrame, vectors: DataFrame, path: str, config: str) -> DataFrame:
    """Postings by term and vectors under a path, with a manifest of counts; unequal documents are an error."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    key = next(c for c in postings.columns if c not in ("term", "tf", "length"))
    a = spark.read.parquet(f"{path}/postings").agg(F.count_distinct(key)).first()[0]
    b = spark.read.parquet(f"{path}/vectors").count()
    if a > b:
        raise ValueError(f"the index has {a} documents with terms and {b} vectors")
    manifest = spark.range(1).select(F.lit(config).alias("config"), F.lit(a).cast("bigint").alias("documents"), F.lit(b).cast("bigint").alias("vectors"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")
