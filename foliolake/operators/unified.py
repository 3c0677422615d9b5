"""Searches over several result types and over the datasets of a project."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import impact
from .browse import between_dates
from .retrieval import PAGE
from .search import search_text, snippet


def unified_search(parts: Mapping[str, DataFrame], terms: Sequence[str], *, offset: int = 0, limit: int = 50) -> DataFrame:
    """Typed hits of several corpora: each part gets its own offset and limit, then one list by rank.

    Each part is a DataFrame ``(document_id, page_number, text)``; ``page_number`` may be NULL.
    """
    ranked = None
    for kind, units in parts.items():
        hits = search_text(units, "text", terms).select(F.lit(kind).alias("type"), *_HIT, "rank")
        cut = hits.orderBy(F.round("rank", 9), *_HIT).offset(offset).limit(limit)
        ranked = cut if ranked is None else ranked.unionByName(cut)
    return ranked.orderBy(F.round("rank", 9), "type", *_HIT).limit(limit)


def match_totals(parts: Mapping[str, DataFrame], terms: Sequence[str]) -> DataFrame:
    """Matches per type without any limit."""
    counts = None
    for kind, units in parts.items():
        n = search_text(units, "text", terms).agg(F.count("*").alias("total")).select(F.lit(kind).alias("type"), "total")
        counts = n if counts is None else counts.unionByName(n)
    return counts


_HIT = ["document_id", "page_number"]


def dated_search(pages: DataFrame, documents: DataFrame, terms: Sequence[str], *, date_from: str | None = None,
                 date_to: str | None = None, limit: int = 50) -> DataFrame:
    """Ranked pages of documents inside a date range; the corpus numbers stay those of all pages."""
    hits = search_text(pages, "text_content", terms)
    dated = between_dates(documents.select("doc_id", "title", "date"), "date", date_from=date_from, date_to=date_to)
    return hits.join(dated, "doc_id").orderBy(F.round("rank", 9), *PAGE).limit(limit)


def federated_search(pages: DataFrame, query: str, *, dataset: str = "dataset", n_datasets: int, limit: int = 20) -> DataFrame:
    """Pages of every dataset of a project: ``limit // n_datasets + 5`` per dataset, title hits first, ``limit`` in all.

    One table and one pass; statistics and cuts are per dataset (``partitionBy``), not a loop.
    ``pages(dataset, doc_id, title, page_number, text_content)``.
    """
    per_dataset = limit // n_datasets + 5
    hits = search_text(pages, "text_content", query.split())
    order = W.partitionBy(dataset).orderBy(F.round("rank", 9), *PAGE)
    cut = hits.withColumn("n_in_dataset", F.row_number().over(order)).filter(F.col("n_in_dataset") <= per_dataset)
    miss = F.when(F.lower(F.coalesce("title", F.lit(""))).contains(query.lower()), 0).otherwise(1)
    shown = cut.withColumn("title_miss", miss).orderBy("title_miss", dataset, "n_in_dataset").limit(limit)
    return shown.withColumn("snippet", snippet("text_content", query.split(), words=32, open_mark="<mark>", close_mark="</mark>"))


# --- the same from a stored index -------------------------------------------------------------


def typed_search(index: impact.Index, terms: Sequence[str], *, types: Sequence[str] | None = None, documents: DataFrame | None = None,
                 date_from: str | None = None, date_to: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Unified search in one call: ``(type, document_id, page_number, rank, title, date, total)``.

    ``types`` are corpora of the index (None: all).  Each type gets its own offset and limit, then the best ``limit`` of all
    are kept.  Pages are limited to documents ``(doc_id, title, date)`` inside the dates; the other types have none.  ``total``
    counts all matches of all types under the same conditions.  Scores are those of the whole corpus of a type.
    """
    where = F.col("corpus").isin(list(types)) if types is not None else None
    hits = impact.find(index, terms, where=where).select(F.col("corpus").alias("type"), *PAGE, "rank")
    if documents is not None:
        dated = between_dates(documents.select("doc_id", "title", "date"), "date", date_from=date_from, date_to=date_to)
        hits = hits.join(dated.withColumn("type", F.lit(PAGE_TYPE)), ["type", "doc_id"], "left").withColumn("_in", F.col("title").isNotNull() | F.col("date").isNotNull())
        if date_from or date_to:
            hits = hits.filter((F.col("type") != PAGE_TYPE) | F.col("_in"))
        hits = hits.drop("_in")
    else:
        hits = hits.withColumns({"title": F.lit(None).cast("string"), "date": F.lit(None).cast("string")})
    counts = hits.groupBy("type").agg(F.count("*").alias("n"))
    order = [F.round("rank", 9), *PAGE]
    place = F.row_number().over(W.partitionBy("type").orderBy(*order))
    cut = hits.withColumn("_n", place).filter(F.col("_n") <= offset + limit).filter(F.col("_n") > offset).drop("_n")
    shown = cut.orderBy(F.round("rank", 9), "type", *PAGE).limit(limit)
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return shown.select("type", F.col("doc_id").alias("document_id"), "page_number", "rank", "title", "date", total.alias("total"))


def typed_totals(index: impact.Index, terms: Sequence[str]) -> DataFrame:
    """Matches per type without any limit; a type without any is listed with 0."""
    found = impact.find(index, terms).groupBy("corpus").agg(F.count("*").alias("n"))
    return index.corpus.select("corpus").distinct().join(found, "corpus", "left").select(
        F.col("corpus").alias("type"), F.coalesce("n", F.lit(0)).alias("total"))


def dataset_search(index: impact.Index, documents: DataFrame, query: str, *, n_datasets: int, limit: int = 20) -> DataFrame:
    """Pages of every data set of a project, each scored by its own counts as if it were a store of its own.

    ``limit // n_datasets + 5`` per data set, those with the query in the title of ``documents(doc_id, title)`` first, ``limit``
    in all: ``(dataset, doc_id, page_number, title, n_in_dataset)``.
    """
    hits = impact.find(index, query.split(), by=["dataset"], where=F.col("corpus") == PAGE_TYPE)
    order = W.partitionBy("dataset").orderBy(F.round("rank", 9), *PAGE)
    cut = hits.withColumn("n_in_dataset", F.row_number().over(order)).filter(F.col("n_in_dataset") <= limit // n_datasets + 5)
    titled = cut.join(documents.select("doc_id", "title"), "doc_id")
    miss = F.when(F.lower(F.coalesce("title", F.lit(""))).contains(query.lower()), 0).otherwise(1)
    return titled.withColumn("title_miss", miss).orderBy("title_miss", "dataset", "n_in_dataset").limit(limit)


#: The corpus whose units are pages of documents.
PAGE_TYPE = "page"
