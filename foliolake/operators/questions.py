"""Page search for batches of questions, from query terms to evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import write_store
from .asked import best_units
from .retrieval import PAGE, first_occurrences, fuse, number_results, prepend, sibling_keys, with_adjacent
from .search import match_window, search, snippet, top_k

QUESTION = "question_id"
#: Text list, vector list and overview pages of a question together.
HYBRID_ROWS = 200


def find_pages(postings: DataFrame, doclens: DataFrame | None, query_terms: DataFrame, *, terms: DataFrame | None = None,
               corpus: DataFrame | None = None, per_query: int = 10, total: int = 50) -> DataFrame:
    """``(question_id, query_no, doc_id, page_number, rank, position, ordinal)``.

    ``query_terms(question_id, query_no, term)``: each query keeps its ten best pages; a page counts
    once per question, at the first query that finds it; at most ``total`` pages per question.  Queries of the same terms
    are searched for once, whatever number of questions ask them.
    """
    key, asked = [QUESTION, "query_no"], _asked(query_terms)
    sets = asked.groupBy("_same").agg(F.first("_terms").alias("_terms")).select("_same", F.explode("_terms").alias("term"))
    ranked = search(postings, doclens, sets, PAGE, query=["_same"], terms=terms, corpus=corpus)
    best = top_k(ranked, per_query, [F.round("rank", 9), *[F.col(c) for c in PAGE]], by=["_same"])
    return first_occurrences(asked.select(*key, "_same").join(best, "_same").drop("_same"), total=total)


def find_pages_in_text(pages: DataFrame, query_terms: DataFrame, folder: str, *, per_query: int = 10, total: int = 50) -> DataFrame:
    """As ``find_pages``, of pages that have no index: each task ranks the pages it reads for all queries, and none moves.

    ``folder`` takes the queries and the numbered terms of the pages.
    """
    write_store({"asked": _asked(query_terms)}, folder)
    asked = query_terms.sparkSession.read.parquet(f"{folder}/asked")
    sets = asked.groupBy("_same").agg(F.first("_terms").alias("_terms"))
    best = best_units(pages, PAGE, "text_content", sets, folder, k=per_query)
    return first_occurrences(asked.select(QUESTION, "query_no", "_same").join(best, "_same").drop("_same"), total=total)


def _asked(query_terms: DataFrame) -> DataFrame:
    """``(question_id, query_no, _same, _terms)``: queries of the same terms have the same ``_same``."""
    key, same = [QUESTION, "query_no"], F.array_join("_terms", "\u0001").alias("_same")
    return query_terms.groupBy(*key).agg(F.array_sort(F.collect_set("term")).alias("_terms")).select(*key, same, "_terms")


def with_titles(hits: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Hit -> page -> document, two equi-joins."""
    return hits.join(pages.select(*PAGE, "text_content"), PAGE).join(documents.select("doc_id", "title"), "doc_id")


def with_made(hits: DataFrame, pages: DataFrame, documents: DataFrame, **made: Column) -> DataFrame:
    """Hits with their title and what is made of ``text_content`` of their page: it is made where the page is read, the page stays there."""
    return hits.join(pages.select(*PAGE, *[c.alias(name) for name, c in made.items()]), PAGE).join(documents.select("doc_id", "title"), "doc_id")


def basic_results(hits: DataFrame, pages: DataFrame, documents: DataFrame, *, chars: int = 2000) -> DataFrame:
    """Hits with title and the head of the page, without context or siblings; heads meet their hits last."""
    titled = hits.join(documents.select("doc_id", "title"), "doc_id")
    return titled.join(pages.select(*PAGE, F.substring("text_content", 1, chars).alias("text")), PAGE)


def full_results(hits: DataFrame, query_terms: DataFrame, pages: DataFrame, documents: DataFrame, *, total: int = 50) -> DataFrame:
    """Hits with snippet, the window around the match, neighbouring pages, then siblings of small documents.

    Rows are numbered and cut by their keys; only those that stay meet their page, and what is made of it is made there.
    """
    key = [QUESTION, "query_no"]
    numbered = number_results(sibling_keys(hits, pages, query=[QUESTION]), total=total)
    terms = query_terms.groupBy(*key).agg(F.collect_set("term").alias("_terms"))
    titled = numbered.join(terms, key, "left").join(documents.select("doc_id", "title"), "doc_id")
    found, hit = titled.join(pages.select(*PAGE, "text_content"), PAGE), F.col("band") == 0
    shown = found.withColumn("snippet", F.when(hit, snippet("text_content", F.col("_terms"))).otherwise(F.substring("text_content", 1, 200)))
    windowed = shown.withColumn("text", F.when(hit, match_window("text_content", "snippet")).otherwise(F.substring("text_content", 1, 2000)))
    return with_adjacent(windowed.drop("text_content", "_terms"), pages, only=hit)


def semantic_results(ranked: DataFrame, pages: DataFrame, documents: DataFrame, *, keys: Sequence[str] = (QUESTION,)) -> DataFrame:
    """Vector hits with title, text with its neighbours, and a head snippet."""
    full = with_titles(ranked, pages, documents)
    headed = full.withColumn("snippet", F.substring("text_content", 1, 200)).withColumnRenamed("text_content", "text")
    return with_adjacent(headed, pages)


def hybrid_results(text_results: DataFrame, near: DataFrame, pages: DataFrame, documents: DataFrame, *,
                   overview: DataFrame | None = None) -> DataFrame:
    """Text results (``full_results``) fused with vector hits ``(question_id, *page, rank_no)``, overview pages in front.

    A page in the text list keeps that list's text with its window, neighbours and snippet; only pages
    that vectors alone found get the page with its neighbours.  A question without vector hits keeps
    its text list as it is.  ``ordinal`` numbers each question's rows from 1.
    """
    on = [QUESTION, *PAGE]
    fused = fuse(text_results, near, keys=[QUESTION], left_rank="ordinal", right_rank="rank_no").select(
        *on, "left_rank", "score", F.col("ordinal").alias("place"))
    shown = ["title", "text", "snippet"]
    kept = fused.filter("left_rank is not null").join(text_results.select(*on, *shown), on).select(*on, "place", "score", *shown)
    added = semantic_results(fused.filter("left_rank is null"), pages, documents).select(*on, "place", "score", *shown)
    results = kept.unionByName(added).withColumn("band", F.lit(0))
    if overview is not None:
        front = overview.join(results.select(*on), on, "left_anti")
        results = prepend(front.select(*on, *shown), results)
    return number_results(results.withColumnRenamed("place", "ordinal"), total=HYBRID_ROWS)
