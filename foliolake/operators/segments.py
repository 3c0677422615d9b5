"""Paging of timed segments: a page ends with the segment that brings it to 30 seconds.

The next page starts at that segment's end, so each page depends on the one before it.  To keep a
very long (or hot) recording out of a single task it is cut into blocks of time:

1. each block works out, for every page start that can reach it, where its own last cut falls;
2. the blocks of a recording are chained (a few numbers per block);
3. each block, now knowing the page it begins in, numbers its segments.

All three are folds over the segments of one block, in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed_values as V

_REACH = "array<struct<reach:double,at:int>>"
_CHAIN = "array<struct<block:bigint,page_start:double,done:bigint>>"


def _entries(parts: Column, earlier: Column, seconds: float) -> Column:
    """``(reach, leaves, cuts)`` per way in: a page start at most ``reach - seconds`` first cuts at ``reach``.

    Only ends higher than all before them can be a first cut, and none after the first that lies
    ``seconds`` beyond every earlier block.
    """
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("i"), F.array().cast(_REACH).alias("out"))

    def look(s: Column, x: Column) -> Column:
        new = (x["end"] > s["best"]) & (s["best"] - earlier < seconds)
        out = F.when(new, F.concat(s["out"], F.array(F.struct(x["end"].alias("reach"), s["i"].alias("at"))))).otherwise(s["out"])
        return F.struct(F.greatest(s["best"], x["end"]).alias("best"), (s["i"] + 1).alias("i"), out.alias("out"))

    ways = F.aggregate(parts, start, look, lambda s: s["out"])

    def walk(way: Column) -> Column:
        first = F.struct(way["reach"].alias("leaves"), F.lit(1).cast("long").alias("cuts"))
        done = F.aggregate(F.slice(parts, way["at"] + 2, F.size(parts)), first, lambda s, x: F.when(
            x["end"] - s["leaves"] >= seconds, F.struct(x["end"].alias("leaves"), (s["cuts"] + 1).alias("cuts"))).otherwise(s))
        return F.struct(way["reach"].alias("reach"), done["leaves"].alias("leaves"), done["cuts"].alias("cuts"))

    return F.transform(ways, walk)


def _chained(blocks: Column, seconds: float) -> Column:
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("done"), F.array().cast(_CHAIN).alias("out"))

    def step(s: Column, b: Column) -> Column:
        seen = F.concat(s["out"], F.array(F.struct(b["block"].alias("block"), s["at"].alias("page_start"), s["done"].alias("done"))))
        hit = F.try_element_at(F.filter(b["ways"], lambda w: w["reach"] - s["at"] >= seconds), F.lit(1))
        return F.struct(F.coalesce(hit["leaves"], s["at"]).alias("at"),
                        (s["done"] + F.coalesce(hit["cuts"], F.lit(0).cast("long"))).alias("done"), seen.alias("out"))

    return F.aggregate(blocks, start, step, lambda s: s["out"])


def number_segments(segments: DataFrame, *, media: str = "media_id", start: str = "start", end: str = "end",
                    order: Sequence[str] = ("start", "end"), seconds: float = V.SEGMENT_PAGE_SECONDS,
                    block_seconds: int = 300) -> DataFrame:
    """Segments with ``page_number`` (from 1); times are seconds from the start of the recording.

    ``order`` must begin with the start time and put the segments of a recording in a total order.
    """
    rest = [c for c in segments.columns if c not in (media, *order)]
    row = F.struct(*order, *[c for c in rest if c != end], *([end] if end in rest else []))
    timed = segments.withColumn(end, F.col(end).cast("double"))
    blocks = timed.groupBy(media, F.floor(F.col(start) / block_seconds).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(row)).alias("parts"), F.max(end).alias("top"))
    before = W.partitionBy(media).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    tops = blocks.select(media, "block", "top").withColumn("earlier", F.coalesce(F.max("top").over(before), F.lit(0.0)))
    slim = blocks.select(media, "block", F.transform("parts", lambda p: F.struct(p[end].alias("end"))).alias("ends"))
    ways = slim.join(tops, [media, "block"]).select(media, "block", _entries(F.col("ends"), F.col("earlier"), seconds).alias("ways"))
    chain = ways.groupBy(media).agg(_chained(F.sort_array(F.collect_list(F.struct("block", "ways"))), seconds).alias("_c"))
    begun = chain.select(media, F.explode("_c").alias("_c")).select(media, "_c.*")

    first = F.struct(F.col("page_start").alias("at"), (F.col("done") + 1).alias("page"), F.array().cast("array<bigint>").alias("out"))

    def number(s: Column, p: Column) -> Column:
        cut = p[end] - s["at"] >= seconds
        return F.struct(F.when(cut, p[end]).otherwise(s["at"]).alias("at"), (s["page"] + cut.cast("long")).alias("page"),
                        F.concat(s["out"], F.array(s["page"])).alias("out"))

    numbered = blocks.join(begun, [media, "block"]).withColumn("pages", F.aggregate("parts", first, number, lambda s: s["out"]))
    return numbered.select(media, F.explode(F.arrays_zip("parts", "pages")).alias("_z")).select(
        media, "_z.parts.*", F.col("_z.pages").alias("page_number"))


def segment_pages(segments: DataFrame, *, media: str = "media_id", text: str = "text", order: Sequence[str] = ("start", "end"),
                  **rules) -> DataFrame:
    """``(media, page_number, text_content, char_count)``; segment texts joined by blanks in order."""
    numbered = number_segments(segments, media=media, order=order, **rules)
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    joined = numbered.groupBy(media, "page_number").agg(F.array_join(F.transform(listed, lambda x: x["_t"]), " ").alias("text_content"))
    return joined.withColumn("char_count", F.length("text_content"))
