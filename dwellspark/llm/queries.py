"""One registered query per operator of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dwellspark.llm import bpe, chaining, fingerprints, lemp, lexical, licences, mixing, ngram_join, packing, pii, quality, rpforest, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(_table(spark, sf_dir, "documents"))


def op3_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.nearest(_table(spark, sf_dir, "embeddings"))


def op11_lemp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemp.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality, "op2_personal_data": op2_personal_data, "op3_chained_passages": op3_chained_passages,
    "op4_packed_ids": op4_packed_ids, "op5_byte_bpe": op5_byte_bpe, "op6_temperature_mixing": op6_temperature_mixing,
    "op7_licence_scan": op7_licence_scan, "op8_ngram_join": op8_ngram_join, "op9_bottom_k": op9_bottom_k,
    "op10_projection_forest": op10_projection_forest, "op11_lemp_negatives": op11_lemp_negatives, "op12_toxicity": op12_toxicity,
    "op13_best_position": op13_best_position,
}
ORACLES: dict[str, str] = {"op6_temperature_mixing": mixing.mixture_sql(), "op7_licence_scan": licences.scan_sql(),
                            "op11_lemp_negatives": lemp.hard_negatives_sql(), "op13_best_position": lexical.ranked_sql()}
