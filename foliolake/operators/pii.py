"""Personal data: find it page by page, then take it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.once import once
from ..functions.spans import all_spans, ascii_pattern, context, find_spans, unicode_pattern
from .search import refresh_index

PATTERNS = {
    "phone": V.PII_PHONE,
    "email": V.EMAIL_ADDRESS,
    "ssn": V.PII_SSN,
    "dob": V.PII_DATE,
    "address": "(?iu)" + V.PII_ADDRESS,
}

#: What a text must hold for a match of the kind, found faster than the match itself.
NEEDS = {
    "phone": r"\d{3}[-.\s]?\d{4}",
    "email": r"@[a-zA-Z0-9.-]",
    "ssn": r"\d{2}[-\s]?\d{4}",
    "dob": r"\d[/-]\d{1,2}[/-]\d{2}| \d{1,2},? \d{4}",
    "address": r"\d\s+\p{L}{2,}\s",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"(?U)\D", "")


def _near_url_or_stamp(text: Column, start: Column, end: Column, width: int, ascii_words: bool) -> Column:
    around = context(text, start, end, width)
    return around.rlike(V.URL_MARK) | around.rlike((ascii_pattern if ascii_words else unicode_pattern)(V.ID_STAMP))


def false_ssn(match: Column, text: Column, start: Column, end: Column, *, ascii_words: bool = False) -> Column:
    digits = _digits(match)
    return (
        digits.rlike(r"^(.)\1*$")
        | F.substring(digits, 1, 3).isin("000", "666")
        | digits.startswith("9")
        | (F.substring(digits, 4, 2) == "00")
        | (F.substring(digits, 6, 4) == "0000")
        | _near_url_or_stamp(text, start, end, V.SSN_CONTEXT, ascii_words)
    )


def false_phone(match: Column, text: Column, start: Column, end: Column, *, ascii_words: bool = False) -> Column:
    digits = _digits(match)
    return (
        digits.rlike(r"^(.)\1*$")
        | F.contains(F.lit(V.DIGIT_RUN), digits)
        | _near_url_or_stamp(text, start, end, V.PHONE_CONTEXT, ascii_words)
    )


def near_birth_word(text: Column, start: Column, end: Column) -> Column:
    """A birth keyword (as a substring: ``page`` holds ``age``) within reach of the match."""
    around = context(F.lower(text), start, end, V.BIRTH_CONTEXT)
    hit = F.contains(around, F.lit(V.BIRTH_KEYWORDS[0]))
    for word in V.BIRTH_KEYWORDS[1:]:
        hit = hit | F.contains(around, F.lit(word))
    return hit


def scan_pii(pages: DataFrame, *, text: str = "text_content", kinds: list[str] | None = None,
             min_confidence: float = 0.0, ascii_words: bool = False) -> DataFrame:
    """``(…keys, match_text, pattern_type, confidence, start, end)`` for every page column but the text.

    One narrow pass: five patterns, false-positive rules from the text around each match.  Words end at a letter of any
    script; with ``ascii_words`` an accented letter ends a word as a blank does, which is how SQL engines with RE2 match.
    """
    patterns = {k: p for k, p in PATTERNS.items() if kinds is None or k in kinds}
    keys = [c for c in pages.columns if c != text]
    spans = find_spans(pages.filter(F.col(text) != ""), text, patterns, type_column="pattern_type", ascii_words=ascii_words, needs=NEEDS)
    kind = F.col("pattern_type")
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in V.PII_CONFIDENCE.items() for x in kv]), kind)
    found = spans.filter(_genuine(kind, F.col("match"), F.col(text), F.col("start"), F.col("end"), ascii_words)).select(
        *keys, F.col("match").alias("match_text"), "pattern_type", confidence.alias("confidence"), "start", "end"
    )
    return found.filter(F.col("confidence") >= min_confidence) if min_confidence else found


def _genuine(kind: Column, match: Column, text: Column, start: Column, end: Column, ascii_words: bool) -> Column:
    return (
        F.when(kind == "ssn", ~false_ssn(match, text, start, end, ascii_words=ascii_words))
        .when(kind == "phone", ~false_phone(match, text, start, end, ascii_words=ascii_words))
        .when(kind == "dob", near_birth_word(text, start, end))
        .otherwise(True)
    )


def pii_summary(matches: DataFrame, *, page: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    return matches.agg(F.count("*").alias("match_count"), F.countDistinct(*page).alias("affected_pages"))


def pii_by_type(matches: DataFrame, *, min_confidence: float = 0.0) -> DataFrame:
    """Counts by type: the scan table, and with a threshold the dry run of a redaction."""
    return matches.filter(F.col("confidence") >= min_confidence).groupBy("pattern_type").agg(F.count("*").alias("matches"))


def merged_spans(spans: Column) -> Column:
    """Overlapping or touching ``struct(start, end)`` joined; ``spans`` must be sorted by start."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(out: Column, span: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(F.size(out) == 0, F.array(span)).when(
            span["start"] <= last["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))
        ).otherwise(F.concat(out, F.array(span)))

    return F.aggregate(spans, empty, step)


def redact(pages: DataFrame, matches: DataFrame, *, page: tuple[str, ...] = ("doc_id", "page_number"),
           text: str = "text_content", exact_overlap: bool = False) -> DataFrame:
    """Pages with the matched characters gone, ``char_count`` redone and ``redacted`` items counted.

    Overlapping matches are merged first.  ``exact_overlap`` cuts them one by one from the end
    instead, which shifts positions under an overlap.  Matches on unknown pages change nothing.
    """
    span = F.struct(F.col("start").alias("start"), F.col("end").alias("end"))
    # the group is one page: its spans cannot outgrow the page's own text
    per_page = matches.groupBy(*page).agg(F.sort_array(F.collect_list(span)).alias("_spans"), F.count("*").alias("_items"))
    spans = F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int>>"))
    todo = spans if exact_overlap else merged_spans(spans)
    out = pages.join(per_page, list(page), "left").withColumn(
        text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(_without(F.col(text), todo))
    )
    out = out.withColumn("char_count", F.length(text)).withColumn("redacted", F.coalesce("_items", F.lit(0)))
    return out.drop("_spans", "_items")


def _without(text: Column, spans: Column) -> Column:
    """The text with the spans, sorted by start, cut out from the last to the first."""
    def cut(body: Column, s: Column) -> Column:
        return F.concat(F.substring(body, F.lit(1), s["start"]), F.substring(body, s["end"] + 1, F.length(body)))

    return F.aggregate(F.reverse(spans), text, cut)


def redact_found(pages: DataFrame, *, text: str = "text_content", kinds: list[str] | None = None, ascii_words: bool = False) -> DataFrame:
    """``redact`` by what ``scan_pii`` finds in the same pages: found and cut in the row, nothing is joined."""
    patterns, body = {k: p for k, p in PATTERNS.items() if kinds is None or k in kinds}, F.col(text)
    found = F.filter(all_spans(body, patterns, type_column="pattern_type", ascii_words=ascii_words, needs=NEEDS),
                     lambda s: _genuine(s["pattern_type"], s["match"], body, s["start"], s["end"], ascii_words))
    marked = once(pages, _spans=F.coalesce(found, F.array().cast("array<struct<pattern_type:string,match:string,start:int,end:int>>")))
    spans = F.sort_array(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    out = marked.withColumn("redacted", F.size("_spans").cast("long"))
    out = once(out.withColumn("_text", F.when(F.size("_spans") == 0, body).otherwise(_without(body, merged_spans(spans)))).drop(text, "_spans"), **{text: F.col("_text")})
    return out.drop("_text").withColumn("char_count", F.length(text))


def redact_index(postings: DataFrame, redacted_pages: DataFrame, unit: tuple[str, ...] = ("doc_id", "page_number"),
                 text: str = "text_content") -> DataFrame:
    """Postings brought in line with redacted pages; untouched pages are not tokenised again."""
    return refresh_index(postings, redacted_pages.filter("redacted > 0"), None, unit, text)
