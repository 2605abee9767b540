"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_url_filter, op2_ngram_join, op3_gru_lm, op4_embedding_dedup, op5_quality, op6_toxicity, op7_packing, op8_bpe, op9_media, op10_pii, op11_fim, op12_decontaminate, op13_divergence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter.query,
    "op2_ngram_join": op2_ngram_join.query,
    "op3_gru_lm": op3_gru_lm.query,
    "op4_embedding_dedup": op4_embedding_dedup.query,
    "op5_quality": op5_quality.query,
    "op6_toxicity": op6_toxicity.query,
    "op7_packing": op7_packing.query,
    "op8_bpe": op8_bpe.query,
    "op9_media": op9_media.query,
    "op10_pii": op10_pii.query,
    "op11_fim": op11_fim.query,
    "op12_decontaminate": op12_decontaminate.query,
    "op13_divergence": op13_divergence.query,
}

SQL: dict[str, str] = {"op1_url_filter": op1_url_filter.SQL, "op11_fim": op11_fim.SQL, "op12_decontaminate": op12_decontaminate.SQL, "op13_divergence": op13_divergence.SQL}
