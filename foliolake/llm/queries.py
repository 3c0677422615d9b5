"""Named queries of the operators over the driver tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, gif, language, lsh, packing, prefix_trie, secrets, sentence_pieces, sharding, simhash, token_counts, toxicity
from .common import table
from .twins import SECRETS, VECTOR_DEDUP

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op1_secrets": SECRETS, "op2_vector_dedup": VECTOR_DEDUP}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(table(spark, sf_dir, "documents"))


@query
def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path=path, pattern=public_tokenizers.PATTERN)


@query
def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digest(gif.store_texts(table(spark, sf_dir, "documents")))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path=public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.fingerprints(table(spark, sf_dir, "documents"), words=4)
    found = simhash.near_duplicates(prints, radius=4, similarity=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return sharding.shard_rows(narrow).select(
        "doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


@query
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), path=public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(
        table(spark, sf_dir, "documents"), path_a=public_tokenizers.path("byte_bpe_50k.json"), pattern_a=public_tokenizers.PATTERN,
        path_b=public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
