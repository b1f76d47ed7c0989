"""A corpus from raw documents to token ids: each stage takes what the one before it kept, written and read again.

quality: documents that the classifier rejects go. near_duplicates: one document of each group stays. decontamination: documents
in which a benchmark item is found go. personal_data: entities are replaced by their kind. tokens: ids of the texts that remain.

Cases, for every stage: all columns of documents pass through, whatever their names; rows with a null doc_id, or one that is no
number, are documents of their own; null and empty texts are no near-duplicates, hold no benchmark item and no entities, and
give null and no ids; repeated rows are near-duplicates of each other, of which those with the smallest doc_id stay; very long
texts are worked on whole; an empty table gives no rows. n_chars need not be there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from morsel.llm import bpe, decontam, pii, quality, simhash
from morsel.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps. It is trained on at most quality.MAX_TRAIN of the labelled ones; an empty text is judged
    by the bias alone; without labels all stay."""
    return quality.drop_low_quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id, and all that are in no group."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found; null and empty items are found nowhere."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with <KIND> for each entity of the text; n_chars counts the new text."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of every document; a null text has null figures, an empty one no ids."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("tokens", encode),
]

#: The stages are trained models, connected groups and byte-pair merges, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage for the documents of a folder of tables."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
