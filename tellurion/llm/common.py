"""Shared pieces: shipping the package, shared scratch tables, hash splits, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion import shipping

__all__ = ["connected_components", "lean", "materialise", "remainder", "scratch_dir", "ship_package"]


#: A batch of rows that goes to a Python worker at once, in bytes, where the session leaves it at Spark's default: rows hold whole texts.
BATCH_BYTES, _BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give executors the package, and bound the batches that they exchange with Python."""
    shipping.ship_package(spark)
    if spark.conf.get(_BATCH_KEY) in ("67108864", "67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is missing and Spark runs in one process (tests) a local folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tellurion/{uuid.uuid4().hex}"


def give_back() -> None:
    """Return memory that was freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, with freed memory given back at its end: workers are reused by later stages, and wait meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def materialise(df: DataFrame) -> DataFrame:
    """Write df to a shared table and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: Column, modulus: int) -> Column:
    """crc32(key as text) mod modulus; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of an undirected edge list: (node, component).

    Alternating large-star / small-star rounds. Each round is a grouped minimum (partially
    aggregated before its shuffle) and a join that adaptive execution may split, so that a
    hub with a third of all edges is never gathered in one task. Rounds end when the
    edges are stars around their minima. Edges with a null end and loops are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    cur = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        r = df.agg(F.count("*").alias("n"), F.sum((h % F.lit(1_000_003)).cast("long")).alias("s"), F.bit_xor(h).alias("x")).first()
        return tuple(r)

    before = state(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low2, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(j.select("u", F.col("m").alias("v")))
        cur = materialise(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = state(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
