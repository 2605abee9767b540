"""A bounded, repeatable sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of at most per_class documents of each label value 0 and 1.

    Rows whose id's crc32 leaves held_out modulo modulus are never used. The choice
    is by hash of the id, so it doesn't depend on order or partitions. Both the sample's ids
    and its texts are bounded, so the ids may be broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("y"))
    known = known.where(remainder(F.col("k"), modulus) != held_out).groupBy("k").agg(F.max("y").alias("y"))
    ranked = known.withColumn("h", F.xxhash64("k"))
    ids = None
    for y in (0, 1):
        part = ranked.where(F.col("y") == y).orderBy("h", "k").limit(per_class)
        ids = part if ids is None else ids.unionAll(part)
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(ids), "k").select("text", "y")
