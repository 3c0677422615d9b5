"""Splitting text and transcripts into pages, the unit of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import strip

_STATE = "struct<done:array<string>,cur:string>"


def _state(done: Column, cur: Column) -> Column:
    return F.struct(done.alias("done"), cur.alias("cur"))


def _start() -> Column:
    return _state(F.array().cast("array<string>"), F.lit("")).cast(_STATE)


def packed_pages(text: Column, *, separator: str = "\n\n", target: int = V.PAGE_TARGET_CHARS,
                 minimum: int = V.PAGE_MIN_CHARS) -> Column:
    """Greedy packing of paragraphs into pages of about ``target`` characters, as an array.

    A short text is one page as it stands, a blank long one has none.  A buffer below ``minimum`` that has to give way joins
    the page before it (or stands alone when it is the first); so does a short tail.
    """
    gap = F.lit(separator)
    paragraphs = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")

    def join_last(done: Column, cur: Column) -> Column:
        last = F.concat(F.element_at(done, -1), gap, cur)
        return F.concat(F.slice(done, 1, F.size(done) - 1), F.array(last))

    def step(state: Column, para: Column) -> Column:
        done, cur = state["done"], state["cur"]
        grown = F.length(cur) + len(separator) + F.length(para)
        stands = (F.length(cur) >= minimum) | (F.size(done) == 0)
        flushed = F.when(stands, F.concat(done, F.array(cur))).otherwise(join_last(done, cur))
        return (
            F.when(cur == "", _state(done, para))
            .when(grown > target, _state(flushed, para))
            .otherwise(_state(done, F.concat(cur, gap, para)))
        )

    def finish(state: Column) -> Column:
        done, cur = state["done"], state["cur"]
        return (
            F.when(cur == "", done)
            .when((F.length(cur) >= minimum) | (F.size(done) == 0), F.concat(done, F.array(cur)))
            .otherwise(join_last(done, cur))
        )

    return F.when(F.length(text) <= target, F.array(text)).otherwise(F.aggregate(paragraphs, _start(), step, finish))


def section_pages(text: Column, *, separator: str = "\n\n", minimum: int = V.SECTION_MIN_CHARS) -> Column:
    """Pages at form feeds where there are any, else at section breaks with short sections merged forward."""
    gap = F.lit(separator)
    by_feed = F.filter(F.split(text, "\f"), lambda p: strip(p) != "")
    sections = F.filter(F.split(text, separator), lambda p: strip(p) != "")

    def step(state: Column, part: Column) -> Column:
        done, cur = state["done"], state["cur"]
        return (
            F.when(cur == "", _state(done, part))
            .when(F.length(cur) >= minimum, _state(F.concat(done, F.array(cur)), part))
            .otherwise(_state(done, strip(F.concat(cur, gap, part))))
        )

    def finish(state: Column) -> Column:
        return F.when(strip(state["cur"]) != "", F.concat(state["done"], F.array(state["cur"]))).otherwise(state["done"])

    merged = F.aggregate(sections, _start(), step, finish)
    pages = F.when(F.contains(text, F.lit("\f")), by_feed).otherwise(merged)
    # bound by a one-element array so that the fold runs once
    return F.element_at(F.transform(F.array(pages), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text))), 1)


def _explode(df: DataFrame, pages: Column, doc_id: str, keep: list[str]) -> DataFrame:
    return df.select(doc_id, *keep, F.posexplode(pages).alias("_pos", "text_content")).select(
        doc_id,
        *keep,
        (F.col("_pos") + 1).alias("page_number"),
        "text_content",
        F.length("text_content").alias("char_count"),
    )


def paginate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", separator: str = "\n\n",
             target: int = V.PAGE_TARGET_CHARS, minimum: int = V.PAGE_MIN_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Pages of each document by greedy packing; blank documents have none.  Narrow: no shuffle."""
    docs = docs.filter(strip(text) != "")
    pages = packed_pages(F.col(text), separator=separator, target=target, minimum=minimum)
    return _explode(docs, pages, doc_id, keep or [])


def split_pages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", separator: str = "\n\n",
                minimum: int = V.SECTION_MIN_CHARS, keep: list[str] | None = None) -> DataFrame:
    return _explode(docs, section_pages(F.col(text), separator=separator, minimum=minimum), doc_id, keep or [])


def single_pages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole-text pages for plain files; blank files are skipped."""
    return docs.filter(strip(text) != "").select(
        doc_id, F.lit(1).alias("page_number"), F.col(text).alias("text_content"), F.length(text).alias("char_count")
    )
