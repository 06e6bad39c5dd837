"""Readers: CSV (compressed too), JSON lines, Parquet, ORC, JDBC, zipped tables, HTML tables, embedded databases."""

from __future__ import annotations

import html
import io
import os
import re
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    pass


def require_columns(df: DataFrame, names: Sequence[str], what: str = "the table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(f"{what} lacks {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, required: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """Delimited text with a header; the codec follows the suffix (.gz, .bz2, .zst). The schema is never inferred."""
    return require_columns(spark.read.schema(schema).csv(path, header=True, sep=sep, mode="FAILFAST"), required, path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines)."""
    kind = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"), "value")
    return parsed.where("j._bad is null").select("j.*").drop("_bad"), parsed.where("j._bad is not null").select(F.col("value").alias("line"))


def read_zip_tables(spark: SparkSession, path: str, member: str, columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """A delimited member of every ZIP archive under a path, all columns as text, with the archive's path.

    Archives are read whole, one a row, and unpacked where they lie; a broken byte becomes a mark.
    """
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in ["archive", *columns]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if member not in z.namelist():
                        continue
                    with io.TextIOWrapper(z.open(member), "utf-8-sig", errors="replace", newline="") as f:
                        for part in pd.read_csv(f, sep=sep, dtype=str, keep_default_na=False, na_values=[""], chunksize=50_000, quoting=3):
                            part = part.reindex(columns=list(columns)).astype(object)
                            yield pd.DataFrame({"archive": [name] * len(part), **{c: part[c].where(part[c].notna(), None) for c in columns}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, kinds)


CELL = re.compile(r"<t[dh][^>]*>(.*?)</t[dh]>", re.I | re.S)
ROW = re.compile(r"<tr[^>]*>(.*?)</tr>", re.I | re.S)


def html_table_rows(page: str) -> list[list[str]]:
    """Cells of all table rows as plain text."""
    plain = lambda c: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", c)).split())
    return [[plain(c) for c in CELL.findall(r)] for r in ROW.findall(page)]


def read_html_tables(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, row, cells) of the tables in a column of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, p in zip(pdf[key], pdf[page], strict=True) for i, c in enumerate(html_table_rows(p or ""))]
            yield pd.DataFrame(rows, columns=[key, "row", "cells"])

    return df.select(key, page).mapInPandas(run, T.StructType([df.schema[key], T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))]))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of every SQLite file under a path, files dealt to tasks, rows streamed in batches.

    For the single-file stores this data comes from; on a cluster land them as Parquet once.
    """
    kind = T.StructType.fromDDL(schema)
    names = kind.fieldNames()
    quoted = '"' + table.replace('"', '""') + '"'

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db", delete=False) as f:
                    f.write(content)
                try:
                    con = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    cur = con.execute(f"SELECT {', '.join(names)} FROM {quoted}")
                    while rows := cur.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)
                    con.close()
                finally:
                    os.unlink(f.name)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, kind)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table, read in parallel over ranges of a numeric column if one is named."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        r = r.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return r.load()


def unread_objects(manifest: DataFrame, cache: DataFrame, key: str, fetched: str, max_age_days: int, now: str) -> DataFrame:
    """Manifest entries without a fresh cached object."""
    fresh = cache.where(F.col(fetched) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max_age_days)))
    return manifest.join(fresh.select(key), key, "left_anti")
