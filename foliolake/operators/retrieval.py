"""Evidence for questions: page search, context, fusion, caps, sources and conversation history.

Ranks are explicit columns everywhere; the order of a DataFrame means nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed_values as V
from ..functions.text import strip, truncate
from .ordered import newest_cutoff, numbered, with_next

PAGE = ["doc_id", "page_number"]


# --- page context -----------------------------------------------------------------------------


def with_adjacent(hits: DataFrame, pages: DataFrame, *, chars: int = 300, text: str = "text", only: Column | None = None) -> DataFrame:
    """Tail of page n-1 and head of page n+1 around each hit (that meets ``only``); a page number that is missing adds nothing.

    Equi-joins on (document, page): page numbers may skip, so ``lag``/``lead`` would take the wrong page.
    """
    page_text = F.col("text_content")
    before = pages.select("doc_id", (F.col("page_number") + 1).alias("page_number"),
                          strip(F.substring(page_text, -chars, chars)).alias("_before"))
    after = pages.select("doc_id", (F.col("page_number") - 1).alias("page_number"),
                         strip(F.substring(page_text, 1, chars)).alias("_after"))
    joined = hits.join(before, PAGE, "left").join(after, PAGE, "left")
    head = F.when(F.coalesce("_before", F.lit("")) != "", F.concat(F.lit("[...]"), F.col("_before")))
    tail = F.when(F.coalesce("_after", F.lit("")) != "", F.concat(F.col("_after"), F.lit("[...]")))
    around = F.concat_ws("\n", head, F.col(text), tail)
    return joined.withColumn(text, around if only is None else F.when(only, around).otherwise(F.col(text))).drop("_before", "_after")


def with_siblings(hits: DataFrame, pages: DataFrame, *, max_pages: int = 6, query: Sequence[str] = ()) -> DataFrame:
    """Hits (``band`` 0) plus all other pages of small hit documents (``band`` 1), bare text and a head snippet.

    Result order is (band, ordinal, doc_id, page_number); ``number_results`` turns it into ranks.
    """
    query = list(query)
    keyed = sibling_keys(hits.select(*query, *PAGE), pages, max_pages=max_pages, query=query).filter("band = 1")
    siblings = keyed.join(pages, PAGE).select(*query, *PAGE, F.substring("text_content", 1, 2000).alias("text"),
                                              F.substring("text_content", 1, 200).alias("snippet"), "band")
    return hits.withColumn("band", F.lit(0)).unionByName(siblings, allowMissingColumns=True)


def sibling_keys(hits: DataFrame, pages: DataFrame, *, max_pages: int = 6, query: Sequence[str] = ()) -> DataFrame:
    """The rows of ``with_siblings`` by key, without text: pages are counted and found by their numbers."""
    query, numbers = list(query), pages.select(*PAGE)
    hit_docs = hits.select(*query, "doc_id").distinct()
    sizes = numbers.join(hit_docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("_n"))
    small = hit_docs.join(sizes.filter(F.col("_n") <= max_pages).select("doc_id"), "doc_id")
    fresh = small.join(numbers, "doc_id").join(hits.select(*query, *PAGE), [*query, *PAGE], "left_anti")
    return hits.withColumn("band", F.lit(0)).unionByName(fresh.select(*query, *PAGE, F.lit(1).alias("band")), allowMissingColumns=True)


def number_results(results: DataFrame, *, keys: Sequence[str] = ("question_id",), rank: str = "ordinal", total: int = 50) -> DataFrame:
    """Ranks 1… over (band, rank, page) per question, the first ``total`` kept; the cut comes before the shuffle too."""
    order = W.partitionBy(*keys).orderBy("band", F.asc_nulls_last(rank), *PAGE)
    numbered = results.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= total)
    return numbered.withColumn(rank, F.col("_n")).drop("_n")


def named_documents(questions: DataFrame, *, question: str = "question", keys: Sequence[str] = ("question_id",),
                    patterns: Sequence[str] = tuple(V.NAMED_DOCUMENT_IDS)) -> DataFrame:
    """Document ids a question names: one row per (question, id); stamps upper case, mail ids lower case."""
    upper, lower = patterns[0], list(patterns[1:])
    found = F.transform(F.regexp_extract_all(question, F.lit("(?i)" + upper), F.lit(0)), F.upper)
    for p in lower:
        found = F.concat(found, F.transform(F.regexp_extract_all(question, F.lit("(?i)" + p), F.lit(0)), F.lower))
    return questions.select(*keys, F.explode(F.array_distinct(found)).alias("named_id"))


def overview_pages(named: DataFrame, documents: DataFrame, pages: DataFrame, hits: DataFrame | None = None, *,
                   keys: Sequence[str] = ("question_id",), first: int = 5) -> DataFrame:
    """First pages of each named document, found by title or by id, less the pages already found.

    The OR of the lookup is a union of two equi-joins.
    """
    keys = list(keys)
    text_id = F.col("doc_id").cast("string")
    by_title = named.join(documents.select(F.col("title").alias("named_id"), "doc_id", "title"), "named_id")
    by_id = named.join(documents.select(text_id.alias("named_id"), "doc_id", "title"), "named_id")
    docs = by_title.unionByName(by_id).distinct()
    order = W.partitionBy(*keys, "named_id").orderBy("page_number", "doc_id")
    opened = docs.join(pages, "doc_id").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first)
    out = opened.groupBy(*keys, *PAGE).agg(F.first("title").alias("title"), F.first("text_content").alias("_text")).select(
        *keys, *PAGE, "title", F.substring("_text", 1, 2000).alias("text"), F.substring("_text", 1, 200).alias("snippet"))
    return out.join(hits.select(*keys, *PAGE), [*keys, *PAGE], "left_anti") if hits is not None else out


def prepend(front: DataFrame, results: DataFrame) -> DataFrame:
    """Overview pages go ahead of all results (``band`` -1)."""
    banded = results if "band" in results.columns else results.withColumn("band", F.lit(0))
    return front.withColumn("band", F.lit(-1)).unionByName(banded, allowMissingColumns=True)


# --- ranking ----------------------------------------------------------------------------------


def first_occurrences(ranked: DataFrame, *, question: Sequence[str] = ("question_id",), query_no: str = "query_no",
                      rank: str = "position", total: int = 50) -> DataFrame:
    """A page found by several queries of a question counts once, at its first query; at most ``total`` pages."""
    question = list(question)
    other = [c for c in ranked.columns if c not in (*question, *PAGE)]
    best = ranked.groupBy(*question, *PAGE).agg(
        F.min_by(F.struct(*other), F.struct(query_no, rank)).alias("_r")).select(*question, *PAGE, "_r.*")
    order = W.partitionBy(*question).orderBy(query_no, rank, *PAGE)
    return best.withColumn("ordinal", F.row_number().over(order)).filter(F.col("ordinal") <= total)


def fuse(left: DataFrame, right: DataFrame, *, keys: Sequence[str] = (), k: int = 60, left_rank: str = "rank_no",
         right_rank: str = "rank_no") -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists on (document, page): ``score``, both ranks and ``ordinal``.

    Ranks count from 1.  Ties go to the better left rank, then to the better right rank.
    """
    on = [*keys, *PAGE]
    a = left.select(*on, F.col(left_rank).alias("left_rank"), F.lit(None).cast("int").alias("right_rank"))
    b = right.select(*on, F.lit(None).cast("int").alias("left_rank"), F.col(right_rank).alias("right_rank"))
    merged = a.unionByName(b).groupBy(*on).agg(F.min("left_rank").alias("left_rank"), F.min("right_rank").alias("right_rank"))

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))

    scored = merged.withColumn("score", part("left_rank") + part("right_rank"))
    order = W.partitionBy(*(keys or [F.lit(1)])).orderBy(
        F.desc("score"), F.asc_nulls_last("left_rank"), F.asc_nulls_last("right_rank"))
    return scored.withColumn("ordinal", F.row_number().over(order))


def cap_per_document(results: DataFrame, *, keys: Sequence[str] = ("question_id",), rank: str = "ordinal", most: int = 4,
                     dominant: float = 0.70) -> DataFrame:
    """At most ``most`` pages per document in rank order; a document with 70 % of a question's rows is not cut.

    Shares come from counts; the dominant document passes through a join, and the row limit of all
    others is applied before their shuffle, so no window ever holds a whole question.
    """
    keys = list(keys)
    counts = results.groupBy(*keys, "doc_id").agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    leaders = counts.join(totals, keys).filter(F.col("_n") / F.col("_total") >= dominant).select(*keys, "doc_id")
    whole = results.join(leaders, [*keys, "doc_id"], "left_semi")
    nth = F.row_number().over(W.partitionBy(*keys, "doc_id").orderBy(rank))
    cut = results.join(leaders, [*keys, "doc_id"], "left_anti").withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")
    return whole.unionByName(cut)


def best_sources(results: DataFrame, *, keys: Sequence[str] = ("question_id",), rank: str = "ordinal", most: int = 15) -> DataFrame:
    """The best-ranked page of each document, at most ``most`` documents per question."""
    keys = list(keys)
    other = [c for c in results.columns if c not in (*keys, "doc_id")]
    best = results.groupBy(*keys, "doc_id").agg(F.min_by(F.struct(*other), rank).alias("_r")).select(*keys, "doc_id", "_r.*")
    order = W.partitionBy(*keys).orderBy(rank)
    return best.withColumn("source_no", F.row_number().over(order)).filter(F.col("source_no") <= most)


def title_first(results: DataFrame, query: str, *, ordinal: str = "ordinal", title: str = "title", position: str | None = None) -> DataFrame:
    """Stable re-rank: titles that contain the query come first.  ``position`` names a column for the new rank, from 1."""
    hit = F.lower(F.coalesce(title, F.lit(""))).contains(query.lower())
    marked = results.withColumn("_miss", F.when(hit, 0).otherwise(1))
    return (numbered(marked, ["_miss", ordinal], position) if position else marked.orderBy("_miss", ordinal)).drop("_miss")


# --- evidence ---------------------------------------------------------------------------------


def evidence_text(results: DataFrame, *, keys: Sequence[str] = ("question_id",), rank: str = "ordinal", body: str = "text") -> DataFrame:
    """One evidence text per question: headed page blocks in rank order, a blank line between."""
    block = F.concat(F.lit("### "), F.col("title"), F.lit(" ["), F.col("doc_id").cast("string"), F.lit(", page "),
                     F.col("page_number").cast("string"), F.lit("]\n"), F.col(body))
    listed = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))
    return results.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("evidence"),
                                      F.count("*").alias("n_pages"))


def answer_report(questions: DataFrame, results: DataFrame, corpus_size: DataFrame, n_queries: DataFrame, *,
                  keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """What a question gets without a model: its ten best snippets, or how much was searched in vain."""
    keys = list(keys)
    top = results.filter(F.col("ordinal") <= 10)
    snippets = evidence_text(top, keys=keys, body="snippet").select(*keys, F.col("evidence").alias("_found"))
    joined = questions.select(*keys).join(n_queries, keys, "left").join(snippets, keys, "left").withColumn("_n", corpus_size.scalar())
    tried = F.coalesce("n_queries", F.lit(0))
    missed = F.concat(F.lit("Searched "), F.col("_n").cast("string"), F.lit(" documents using "), tried.cast("string"),
                      F.when(tried == 1, " query").otherwise(" queries"))
    return joined.select(*keys, F.col("_found").isNotNull().alias("found"), F.coalesce("_found", missed).alias("report"))


# --- conversations ----------------------------------------------------------------------------


def split_history(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", max_turns: int = 6) -> DataFrame:
    """Messages with ``recent``: true for the last ``2 * max_turns`` of a conversation (kept word for word)."""
    cutoff = newest_cutoff(messages, conv, turn, 2 * max_turns)
    return messages.join(cutoff, conv).withColumn(
        "recent", F.col("cutoff").isNull() | (F.col(turn) >= F.col("cutoff"))).drop("cutoff")


def history_lines(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", max_turns: int = 6,
                  question_chars: int = 150, answer_chars: int = 600) -> DataFrame:
    """``(conv_id, turn, line)``: older question/answer pairs, shortened, one row each.

    A pair is a user message directly followed by an assistant message, both outside the recent
    part.  Rows keep a very long conversation spread over tasks.
    """
    dropped = split_history(messages, conv=conv, turn=turn, max_turns=max_turns).filter(~F.col("recent"))
    slim = dropped.select(conv, turn, "role", F.substring("text", 1, max(question_chars, answer_chars) + 1).alias("text"))
    paired = with_next(slim, conv, turn, ["role", "text"]).filter("role = 'user' AND next_role = 'assistant'")
    answer = F.concat(strip(F.substring("next_text", 1, answer_chars)),
                      F.when(F.length("next_text") > answer_chars, "...").otherwise(""))
    line = F.concat(F.lit("Q: "), strip(truncate("text", question_chars)), F.lit("\nA: "), answer, F.lit("\n"))
    return paired.select(conv, turn, line.alias("line"))


def history_text(lines: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One block per conversation under the fixed heading, for conversations that go into a prompt whole."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("line").alias("l")))), lambda x: x["l"])
    return lines.groupBy(conv).agg(F.array_join(F.concat(F.array(F.lit(V.HISTORY_HEADER)), listed), "\n").alias("history"))


def prompt_context(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", max_turns: int = 6) -> DataFrame:
    """Context rows per conversation, ordered by (part, seq): heading, condensed pairs, acknowledgement, recent messages.

    Parts 0 and 1 together are the condensed user message; they exist for long conversations only.
    """
    split = split_history(messages, conv=conv, turn=turn, max_turns=max_turns)
    long_ones = split.filter(~F.col("recent")).select(conv).distinct()
    lines = history_lines(messages, conv=conv, turn=turn, max_turns=max_turns)

    def rows(df: DataFrame, part: int, seq, role, content) -> DataFrame:
        return df.select(conv, F.lit(part).alias("part"), seq.cast("long").alias("seq"), role.alias("role"), content.alias("content"))

    zero = F.lit(0)
    return (
        rows(long_ones, 0, zero, F.lit("user"), F.lit(V.HISTORY_HEADER))
        .unionByName(rows(lines, 1, F.col(turn), F.lit("user"), F.col("line")))
        .unionByName(rows(long_ones, 2, zero, F.lit("assistant"), F.lit(V.HISTORY_ACK)))
        .unionByName(rows(split.filter("recent"), 3, F.col(turn), F.col("role"), F.col("text")))
    )
