"""Queries of the operators in this folder, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morsel.llm import ann, bpe, brown, decontam, link_graph, pii, quality, simhash, suffix_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors for each one whose id 100 divides."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), every=ann.EVERY).withColumn("distance", F.round("distance", 6))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.fit_and_score(table(spark, sf_dir, "documents"))


def op8_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge_pages(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with their scores."""
    docs = table(spark, sf_dir, "documents")
    models = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, models).filter("keep").select("doc_id", "quality_score", "toxic_score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold personal data or secrets, with the entities and the redacted text."""
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_additive_ann, op3_suffix_dedup, op4_bpe, op5_simhash, op6_decontamination, op7_brown_lm, op8_link_graph, op9_quality, op10_pii)}
ORACLES: dict[str, str] = {"op2_additive_ann": ann.oracle_sql(), "op3_suffix_dedup": suffix_dedup.oracle_sql(), "op8_link_graph": link_graph.oracle_sql()}
