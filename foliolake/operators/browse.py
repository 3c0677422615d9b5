"""Filters, lookups, sorts and paging over store tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between_dates(df: DataFrame, column: str = "date", *, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Inclusive bounds, each optional; plain comparisons so that they reach the scan."""
    if date_from is not None:
        df = df.filter(F.col(column) >= F.lit(date_from).cast(df.schema[column].dataType))
    if date_to is not None:
        df = df.filter(F.col(column) <= F.lit(date_to).cast(df.schema[column].dataType))
    return df


def contains_any(query: str, *columns: str) -> Column:
    """Case-blind ``contains`` over any of several columns."""
    query = query.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(query), F.lit(False))
    return hit


def persons_page(persons: DataFrame, *, category: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    if category:
        persons = persons.filter(F.col("category") == category)
    if limit is None:
        return persons
    return persons.orderBy("name", "person_id").offset(offset).limit(limit)


def pages_of(pages: DataFrame, doc_id) -> DataFrame:
    return pages.filter(F.col("doc_id") == F.lit(doc_id)).orderBy("page_number")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; on a table clustered by ``key`` the scan skips files by their statistics."""
    return df.filter(F.col(key) == F.lit(value))


def latest_first(df: DataFrame, updated: str, tiebreak: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(updated), F.desc(tiebreak)).limit(n)


def page(df: DataFrame, *order: Column, offset: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def sort_documents(documents: DataFrame, key: str, *, date: str = "date", title: str = "title", tiebreak: str = "doc_id") -> list[Column]:
    """Sort orders of the document list; undated documents come last both ways."""
    return {
        "date_desc": [F.col(date).desc_nulls_last(), F.col(tiebreak).asc()],
        "date_asc": [F.col(date).asc_nulls_last(), F.col(tiebreak).asc()],
        "title": [F.col(title).asc(), F.col(tiebreak).asc()],
    }[key]


def described_images(images: DataFrame) -> DataFrame:
    return images.filter(F.coalesce(F.trim("description"), F.lit("")) != "")


def entity_types(entities: DataFrame) -> DataFrame:
    return entities.select("entity_type").distinct()
