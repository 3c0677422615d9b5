"""From raw documents to packed batches: toxicity, language, near-duplicates, secrets, packing.

Each stage takes the documents its predecessor kept, written as Parquet and read again.  All but the last return
the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliolake.llm import packing, stages
from foliolake.llm.common import stored, table

#: The model-based stages cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return stages.without_toxic(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return stages.with_language(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return stages.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return stages.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of each document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
