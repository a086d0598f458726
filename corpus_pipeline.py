"""Corpus pipeline over `documents`: quality, near duplicates, personal data, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again by the next; all but the last
return the columns of `documents`. Null texts, repeated rows, empty tables and further columns are handled as
the operators' docstrings say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from dwellspark.llm import bpe, mixing, ngram_join, pii, quality
from dwellspark.llm.common import stored
from dwellspark.llm.queries import vocabulary

#: A source is drawn at most so often for each time the largest is; every document is drawn once at least.
REPEATS = 2.0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the rejected go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest id. Rows that share an id are documents of their own if
    their texts differ, and one document if not. Documents without words stay, as do rows without an id."""
    known = docs.where("doc_id IS NOT NULL").withColumn("near_node", F.col("doc_id"))
    text = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    several = known.groupBy(F.col("doc_id").alias("near_id")).agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("near_id")
    if not several.isEmpty():  # ids that stand for more than one text get a node for each
        marked = known.join(several, F.col("doc_id") == F.col("near_id"), "left")
        known = stored(marked.withColumn("near_node", F.when(F.col("near_id").isNull(), F.col("doc_id")).otherwise(text)).drop("near_id"), "nodes")
    groups = ngram_join.ngram_components(known.select(F.col("near_node").alias("doc_id"), "text")).select(F.col("doc_id").alias("near_node"), "component_id")
    first = (known.select("near_node", "doc_id").join(groups.distinct(), "near_node").groupBy("component_id")
             .agg(F.min(F.struct("doc_id", "near_node")).alias("least")).select(F.col("least.near_node").alias("near_node")))
    rank = F.row_number().over(W.partitionBy("near_node").orderBy(F.xxhash64(*docs.columns)))
    one = known.join(first, "near_node", "left_semi").withColumn("row_of_node", rank).where("row_of_node = 1").select(docs.columns)
    return one.union(docs.where("doc_id IS NULL"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in every text."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mixture draws them."""
    return mixing.drawn_documents(docs, "repeats", REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of decoded bytes for every draw."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("quality", keep_quality), ("near_copies", keep_first_of_near_copies), ("personal_data", mask_personal_data),
          ("mixture", mix_sources), ("token_ids", encode)]

#: SQL can express neither the fitted models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
