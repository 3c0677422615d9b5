"""Regex matches with character offsets, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<match:string,start:int,end:int>>"


def unicode_pattern(pattern: str) -> str:
    """Make ``\\b``, ``\\w``, ``\\d`` and ``\\s`` Unicode-aware, as the patterns were written for."""
    return pattern if pattern.startswith("(?U)") else "(?U)" + pattern


#: Between an ASCII letter, digit or ``_`` and anything else.
_ASCII_BOUNDARY = r"(?-iu:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_pattern(pattern: str) -> str:
    """``\\b``, ``\\w``, ``\\d`` and ``\\s`` for ASCII alone, as RE2 and with it SQL engines read them."""
    return pattern.replace(r"\b", _ASCII_BOUNDARY).replace(r"\s", r"[\t\n\f\r\x20]")


def span_array(text: Column, pattern: str, need: str | None = None) -> Column:
    """All matches as ``struct(match, start, end)``; offsets count characters from 0, end is exclusive.

    ``need`` is a cheaper pattern without which ``pattern`` has no match: texts that lack it are not searched further.  ``split`` with limit -1 cuts the text at the very same matches, so the offset of a match
    is the length of all pieces and matches in front of it.
    """
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["g"]
        end = start + F.length(pair["m"])
        found = F.struct(pair["m"].alias("match"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
        return F.when(F.size(matches) == 0, F.array().cast(SPAN)).otherwise(
            F.aggregate(pairs, begin, step, lambda state: state["out"]))

    # bound by a one-element array: the matches are found once, and a text without any is not split
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if need:
        matches = F.when(text.rlike(need), matches).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(matches), placed), 1)


def all_spans(text: Column, patterns: Mapping[str, str], *, type_column: str = "type", ascii_words: bool = False,
              needs: Mapping[str, str] | None = None) -> Column:
    """The matches of all patterns in one array, labelled by their kind."""
    read = ascii_pattern if ascii_words else unicode_pattern

    def labelled(kind: str, pattern: str) -> Column:
        need = (needs or {}).get(kind)
        return F.transform(span_array(text, read(pattern), need and read(need)), lambda s: F.struct(
            F.lit(kind).alias(type_column), s["match"].alias("match"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*[labelled(kind, p) for kind, p in patterns.items()])


def find_spans(df: DataFrame, text: str, patterns: Mapping[str, str], *, type_column: str = "type", ascii_words: bool = False,
               needs: Mapping[str, str] | None = None) -> DataFrame:
    """One row per match of any pattern; the text column stays for context checks.

    Each pattern runs over the text once, and only over texts that have what it ``needs``; only texts with a match pay for
    offsets.  ``ascii_words`` reads the patterns by ``ascii_pattern``, else they are Unicode-aware.
    """
    spans = all_spans(F.col(text), patterns, type_column=type_column, ascii_words=ascii_words, needs=needs)
    return df.filter(F.col(text).isNotNull()).withColumn("_span", F.explode(spans)).select("*", "_span.*").drop("_span")


def context(text: Column, start: Column, end: Column, width: int) -> Column:
    """Text from ``width`` characters before ``start`` to ``width`` after ``end``."""
    begin = F.greatest(start - width, F.lit(0))
    return F.substring(text, begin + 1, end + width - begin)
