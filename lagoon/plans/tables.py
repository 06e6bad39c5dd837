"""The panel views that the queries share, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey", unit: str = "week", extremes: bool = False) -> DataFrame:
    """entity, d, open, close, volume: price bars of an entity and period from its line items."""
    li = table(spark, sf_dir, "lineitem")
    price = F.try_divide("l_extendedprice", "l_quantity")
    # one number of fixed width instead of a struct, so that the aggregation is by hash: microseconds, order, line
    micros, order = F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("decimal(17,0)"), F.col("l_orderkey").cast("decimal(14,0)")
    at = ((micros * F.lit(10**14).cast("decimal(15,0)") + order) * F.lit(1000).cast("decimal(4,0)") + F.col("l_linenumber").cast("decimal(3,0)")).cast("decimal(38,0)")
    return (
        li.where("l_quantity <> 0")
        .groupBy(F.col(entity).alias("entity"), F.date_trunc(unit, "l_shipdate").cast("date").alias("d"))
        .agg(F.min_by(price, at).alias("open"), F.max_by(price, at).alias("close"), F.sum("l_quantity").alias("volume"), *([F.max(price).alias("high"), F.min(price).alias("low")] if extremes else []))
    )


def ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the highest and the lowest price of the period."""
    return bars(spark, sf_dir, extremes=True)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, sector, country: the dimension of suppliers."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("entity"), F.col("r_name").alias("sector"), F.col("n_name").alias("country"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with r, the change of close, and sector."""
    from lagoon.operators.panel import change, ordered

    b = bars(spark, sf_dir)
    return b.withColumn("r", change("close", 1, ordered("entity", "d"))).join(sectors(spark, sf_dir), "entity")


BARS = """bars AS (
    SELECT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS d,
           arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS open,
           arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close,
           sum(l_quantity) AS volume
    FROM lineitem WHERE l_quantity <> 0 GROUP BY 1, 2)"""
SECTORS = """sectors AS (
    SELECT s_suppkey AS entity, r_name AS sector, n_name AS country
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
RETURNS = f"""{BARS}, {SECTORS}, returns AS (
    SELECT b.*, sector, country, close / nullif(lag(close) OVER (PARTITION BY b.entity ORDER BY d), 0) - 1 AS r
    FROM bars b JOIN sectors s ON s.entity = b.entity)"""
OHLC = BARS.replace("sum(l_quantity) AS volume", "sum(l_quantity) AS volume, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low")
