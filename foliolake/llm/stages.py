"""The operators as filters of a documents table: all columns stay, rows go or change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language, secrets, simhash, toxicity
from .common import stored


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose toxicity score is below the threshold.  Null and empty texts score 0 and stay."""
    model = toxicity.train(docs, labels)
    return docs.where(toxicity.score_column(docs, model) < toxicity.DOCUMENT_THRESHOLD)


def with_language(docs: DataFrame) -> DataFrame:
    """Documents that the model finds to be in a learned language.

    Texts that are null or have no letter go, and texts in no learned language: those whose character grams the
    landmarks mostly lack (``language.LEAST_COVER``), or lack more than usual (``language.DOUBTFUL_COVER``) where no
    language scores above ``language.LEAST_SCORE`` or leads by ``language.LEAST_LEAD``.  Where there is nothing to learn
    from (no label, no id, or held-out rows only), every text with a letter stays.
    """
    model = language.train(docs)
    return docs.where(language.known_column(docs, model))


def one_of_each(docs: DataFrame, *, words: int = 5, radius: int = 20, similarity: float = 0.8) -> DataFrame:
    """Of documents that hang together by pairs with ``similarity`` of their word shingles in common, the one with the
    smallest id; and one row of a repeated id.

    SimHash fingerprints within ``radius`` only name candidates, see ``simhash.similar_documents``.  Rows with a null
    id cannot be told apart by it: they stay.
    """
    found = stored(simhash.similar_documents(docs, words=words, radius=radius, similarity=similarity), "found")
    found = found.where("doc_id is not null")
    copies = found.where("doc_id <> component").select("doc_id").distinct()
    # hashed by id at every size: the ids of copies grow with the documents and must not be broadcast
    kept = docs.join(copies.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    repeated = stored(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def without_secrets(docs: DataFrame) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return secrets.redact(docs)
