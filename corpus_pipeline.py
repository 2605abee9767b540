"""A corpus pipeline: five stages, each one of the operators over all that its predecessor kept.

quality classifier -> toxicity -> n-gram Jaccard join -> personal data -> best-fit packing.
A stage gets the documents as its predecessor wrote them (``documents`` itself for the first) and the folder
of tables; it returns documents with the same columns, the last one the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm import op2_ngram_join, op5_quality, op6_toxicity, op7_packing, op10_pii
from tellurion.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(scored: DataFrame, docs: DataFrame, rejected: int) -> DataFrame:
    return scored.where(F.col("__predicted") != rejected).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1 stay.

    Every row is judged by its own text: a null or empty one by its (zero) features, very long ones whole; repeated rows fare alike, ties
    at the threshold count as 1. No usable labels: all scores are 0.5, so nothing stays. Empty tables stay empty. Further columns pass,
    names beginning with ``__`` like the classifier's own are refused.
    """
    model = op5_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(op5_quality.score_documents(docs, model, keep=True), docs, 0)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts as 1 go.

    Rows are judged as in ``quality``; without usable labels all scores are 0.5, so everything stays.
    """
    model = op6_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(op6_toxicity.score_documents(docs, model, keep=True), docs, 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id.

    Links are on five-word shingles at a similarity of 0.8; null, empty and blank texts link with nothing and stay, very long ones count
    whole. Where ids repeat or are null, of rows that agree in every column one stays, and a group keeps its row with the smallest id, null
    ids coming last; of those that share it, the first. Empty tables stay empty. Further columns pass, ``__keep`` and ``__row`` are refused.
    """
    if clash := {"__keep", "__row"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    if _named(docs):
        comp = op2_ngram_join.components(docs, words=5, limit=80)
        keep = comp.where("doc_id = component_id").select(F.col("doc_id").alias("__keep"))
        return docs.join(keep, F.col("doc_id") == F.col("__keep"), "left_semi")
    rows = materialise(docs.distinct().withColumn("__row", F.monotonically_increasing_id()))
    comp = op2_ngram_join.components(rows, words=5, limit=80, id_col="__row").withColumnRenamed("__row", "__keep")
    ids = rows.select("__row", F.col("doc_id").isNull().alias("last"), "doc_id").join(comp, F.col("__row") == F.col("__keep"))
    best = ids.groupBy("component_id").agg(F.min(F.struct("last", "doc_id", "__row")).alias("b")).select(F.col("b.__row").alias("__keep"))
    return rows.join(best, F.col("__row") == F.col("__keep"), "left_semi").drop("__row")


def _named(docs: DataFrame) -> bool:
    """Whether every row has an id of its own."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data in the texts give way to their kind; n_chars follows.

    Rows are treated one by one, whatever their ids; null texts stay null, very long ones are searched whole. Empty tables stay empty.
    Further columns pass, names that begin with ``__pii`` are refused.
    """
    out = op10_pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences.

    A null text counts as empty (its end id alone), very long ones are cut into pieces, repeated rows are all packed, documents of one length
    are ranked by row; no documents give no pieces. Only id and text are read.
    """
    return op7_packing.pack_documents(docs, op7_packing.tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models, token ids and bins can't be had in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
