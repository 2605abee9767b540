"""Survey-shaped views of generic tables: every one keeps column pruning and filters at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds count from 2024-01-01.
EPOCH_US = 1_704_067_200_000_000


def _named(name: str, key: str) -> Column:
    """survey_id of rows that have a key. It depends on the row, so that the optimiser can't turn joins on it into products."""
    return F.when(F.col(key).isNotNull(), F.lit(name)).alias("survey_id")


def events_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track = user, x = seconds, y = user, value."""
    x = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(1_000_000.0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        _named("events", "event_id"), F.col("event_id").alias("pid"), F.col("user_id").cast("int").alias("track"), x.alias("x"), F.col("user_id").cast("double").alias("y"), "value", "event_type"
    )


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 50 x 11 lattice of quantities and discounts; without a unique pid."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        _named("lineitem", "l_orderkey"), F.col("l_orderkey").alias("pid"), F.col("l_suppkey").cast("int").alias("track"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("value")
    )


def orders_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tracks: customers' orders."""
    x = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86_400_000_000.0)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(_named("orders", "o_orderkey"), F.col("o_orderkey").alias("pid"), F.col("o_custkey").cast("int").alias("track"), x.alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_totalprice").alias("value"))


def embeddings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense raster: iy = vec_id, ix = place in the vector."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(_named("embeddings", "vec_id"), F.col("vec_id").cast("int").alias("iy"), F.posexplode("embedding").alias("ix", "e")).select("survey_id", "iy", "ix", F.col("e").cast("double").alias("z"))
