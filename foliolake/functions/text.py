"""Scalar text functions.  Each takes and returns ``Column``; all of them stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

WORD = r"[\p{L}\p{N}]+"
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def _accent_table() -> tuple[str, str]:
    """Latin letters with a diacritic and their base letter, derived from Unicode decompositions."""
    marked, plain = [], []
    for code in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


ACCENTED, UNACCENTED = _accent_table()


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: str | Column) -> Column:
    """Trim every Unicode blank at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(as_column(text), F.lit(V.WHITESPACE))


def blank_to_null(text: str | Column) -> Column:
    text = as_column(text)
    return F.when(strip(text) != "", text)


def normalise(text: str | Column) -> Column:
    """Lower case, blanks collapsed, ends trimmed: the key for names and content hashes."""
    return F.trim(F.regexp_replace(F.lower(as_column(text)), SPACE_RUN, " "))


def fold(text: str | Column) -> Column:
    """Search folding: lower case and no diacritics."""
    return F.translate(F.lower(as_column(text)), ACCENTED, UNACCENTED)


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def token_count(text: str | Column) -> Column:
    return F.regexp_count(as_column(text), F.lit(WORD))


# --- identity ---------------------------------------------------------------------------------


def content_hash(text: str | Column) -> Column:
    return F.sha2(normalise(text), 256)


def content_id(text: str | Column, prefix: str) -> Column:
    """``prefix`` plus the first 12 hex digits of the content hash."""
    return F.concat(F.lit(prefix), F.substring(content_hash(text), 1, 12))


def bytes_id(content: str | Column, prefix: str) -> Column:
    """The same kind of id over raw bytes, for files that are not text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(as_column(content), 256), 1, 12))


def resume_key(path: str | Column) -> Column:
    return F.substring(F.md5(as_column(path)), 1, 16)


def slug(name: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(as_column(name)), "[^a-z0-9]+", "-"), F.lit("-"))


# --- paths ------------------------------------------------------------------------------------


def base_name(path: str | Column) -> Column:
    path = as_column(path)
    last = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)
    return F.coalesce(F.nullif(last, F.lit("")), F.lit("Unknown file"))


def last_dot_part(path: str | Column) -> Column:
    """Lower-cased text after the last dot; the whole string when there is no dot."""
    return F.lower(F.element_at(F.split(as_column(path), "\\."), -1))


def suffix(path: str | Column) -> Column:
    """File extension without the dot, lower case; empty for none or for a leading dot only."""
    name = F.element_at(F.split(as_column(path), "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def stem(path: str | Column) -> Column:
    name = F.element_at(F.split(as_column(path), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def title_from_path(path: str | Column, *, capitalise: bool = False) -> Column:
    title = F.translate(stem(path), "_-", "  ")
    return F.initcap(title) if capitalise else F.trim(title)


def media_format(path: str | Column) -> Column:
    path = as_column(path)
    extension = last_dot_part(path)
    known = F.create_map(*[F.lit(x) for pair in V.MEDIA_FORMATS.items() for x in pair])
    return F.when(path.isNull() | (path == "") | (extension == ""), F.lit("Unknown")).otherwise(
        F.coalesce(F.try_element_at(known, extension), F.upper(extension))
    )


def file_family(extension: str | Column, *, keep_unknown: bool = False) -> Column:
    """pdf / media / text / office / image; otherwise ``other`` or (staging) the extension itself."""
    extension = as_column(extension)
    result = None
    for family, members in V.SCAN_FAMILIES.items():
        rule = extension.isin(members)
        result = F.when(rule, family) if result is None else result.when(rule, family)
    unknown = F.coalesce(F.nullif(extension, F.lit("")), F.lit("other")) if keep_unknown else F.lit("other")
    return result.otherwise(unknown)


def document_type(tags: str | Column, path: str | Column) -> Column:
    tags = F.lower(F.coalesce(as_column(tags), F.lit("")))
    extension = F.coalesce(last_dot_part(path), F.lit(""))
    result = None
    for label, fragments, extensions in V.DOCUMENT_TYPES:
        rule = tags.rlike("|".join(fragments))
        if extensions:
            rule = rule | extension.isin(extensions)
        result = F.when(rule, label) if result is None else result.when(rule, label)
    return result.otherwise("Doc")


def matches_type_filter(tags: str | Column, path: str | Column, wanted: str) -> Column:
    tags = F.lower(F.coalesce(as_column(tags), F.lit("")))
    extension = F.coalesce(last_dot_part(path), F.lit(""))
    rules = {
        "pdf": tags.contains("pdf") | (extension == "pdf"),
        "email": tags.rlike("eml|email|msg") | extension.isin("eml", "msg"),
        "transcript": tags.rlike("transcript|whisper"),
        "spreadsheet": tags.rlike("xlsx|xls|csv") | (extension == "csv"),
        "image": tags.rlike("image|png|jpg"),
        "html": (tags.contains("html") | (extension == "html")) & ~tags.rlike("email|eml"),
        "text": tags.contains("txt") | (extension == "txt"),
    }
    return rules.get(wanted, F.lit(True))


# --- cleaning ---------------------------------------------------------------------------------


def clean_ocr(text: str | Column) -> Column:
    """Drop control characters, long repeats, rules and blank runs left behind by OCR."""
    text = F.regexp_replace(as_column(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    text = F.regexp_replace(text, r"(.)\1{10,}", "$1$1$1")
    text = F.regexp_replace(text, r"[|_=\-]{10,}", "")
    text = F.regexp_replace(text, r"[ \t]{5,}", "  ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def html_to_text(html: str | Column) -> Column:
    """Visible text of a page: scripts, styles and comments dropped, block ends become line ends."""
    text = F.regexp_replace(as_column(html), r"(?is)<(script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<title\b.*?</title>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|ul|ol|table|article|section)>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    text = decode_entities(text)
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    return strip(F.regexp_replace(text, r" ?\n[ \n]*", "\n"))


def decode_entities(text: str | Column) -> Column:
    text = as_column(text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_title(html: str | Column) -> Column:
    return decode_entities(strip(F.regexp_extract(as_column(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


# --- mail headers -----------------------------------------------------------------------------


def _table_cell(field: str) -> str:
    return rf"(?i)\|\s*{field}:\s*\|\s*(.+?)(?:\s*\||\n)"


def _header_line(field: str) -> str:
    return rf"(?im)^{field}:\s*(.+)$"


def _first_found(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def subject_from_text(text: str | Column) -> Column:
    """Subject of mail-like text: the table cell form first, then a header line."""
    return strip(_first_found(as_column(text), [_table_cell("Subject"), _header_line("Subject")]))


def date_from_text(text: str | Column) -> Column:
    """First date a mail-like text states, month first; NULL when none parses."""
    text = as_column(text)
    cell = F.regexp_extract(text, r"(?i)\|\s*Date:\s*\|\s*(?:\w+,\s*)?(\d{1,2}/\d{1,2}/\d{4})", 1)
    worded = F.regexp_extract(text, r"(?im)^Date:\s*(?:\w+,\s*)?(\d{1,2}\s+\w+\s+\d{4})", 1)
    iso = F.regexp_extract(text, r"(?im)^Date:\s*(\d{4}-\d{2}-\d{2})", 1)
    worded = F.initcap(F.regexp_replace(worded, r"\s+", " "))
    return F.coalesce(
        F.try_to_date(F.nullif(cell, F.lit("")), "M/d/yyyy"),
        F.try_to_date(F.nullif(cell, F.lit("")), "d/M/yyyy"),
        F.try_to_date(F.nullif(worded, F.lit("")), "d MMM yyyy"),
        F.try_to_date(F.nullif(worded, F.lit("")), "d MMMM yyyy"),
        F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"),
    )


def looks_like_email(text: str | Column) -> Column:
    text = as_column(text)
    return text.rlike(r"(?i)\|\s*From:\s*\|") | text.rlike(r"(?im)^From:\s+\S")


def email_headers(text: str | Column) -> Column:
    """Struct of the six header fields, back-slash escapes removed; NULL where absent."""
    text = as_column(text)
    fields = []
    for field in V.EMAIL_HEADERS:
        value = _first_found(text, [_table_cell(field), _header_line(field)])
        fields.append(strip(F.regexp_replace(value, r"\\(.)", "$1")).alias(field.lower()))
    return F.struct(*fields)


# --- display ----------------------------------------------------------------------------------


def escape_html(text: str | Column) -> Column:
    text = as_column(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight(text: str | Column, terms: Sequence[str], *, open_mark: str = "<mark>", close_mark: str = "</mark>",
              escape: bool = False) -> Column:
    """Wrap each occurrence of a term, ignoring case; ``escape`` protects the page's own markup first."""
    text = escape_html(text) if escape else as_column(text)
    wanted = [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) for t in terms if t]
    if not wanted:
        return text
    return F.regexp_replace(text, "(?iu)(" + "|".join(wanted) + ")", f"{open_mark}$1{close_mark}")


def occurrences(text: str | Column, query: str) -> Column:
    """Non-overlapping, case-blind occurrences of a literal."""
    if not query.strip():
        return F.lit(0)
    low = F.lower(as_column(text))
    gone = F.replace(low, F.lit(query.lower()), F.lit(""))
    return ((F.length(low) - F.length(gone)) / F.lit(len(query))).cast("int")


def truncate(text: str | Column, size: int, marker: str = "") -> Column:
    text = as_column(text)
    cut = F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(cut, F.lit(marker))).otherwise(cut) if marker else cut


def first_line_title(text: str | Column) -> Column:
    """The whole first line."""
    return F.substring_index(as_column(text), "\n", 1)


# --- composition of document fields ------------------------------------------------------------


def analysis_text(*parts: str | Column) -> Column:
    """Title, summary and body, whichever are present, one per line."""
    return F.concat_ws("\n", *[F.nullif(as_column(p), F.lit("")) for p in parts])


def embeddable_text(body: str | Column, summary: str | Column) -> Column:
    return F.coalesce(F.nullif(as_column(body), F.lit("")), as_column(summary))


def is_embeddable(body: str | Column, summary: str | Column) -> Column:
    body, summary = as_column(body), as_column(summary)
    return F.coalesce(F.length(body) > 50, F.lit(False)) | F.coalesce(summary != "", F.lit(False))


def is_image_heavy(text: str | Column, threshold: int = 100) -> Column:
    text = strip(text)
    return (F.length(text) < threshold) | text.rlike(r"^[A-Z]+\d+$")


def caption_sections(text: str | Column) -> Column:
    """Labelled caption text as a map from lower-cased label to its (joined) lines."""
    heads = "|".join(V.CAPTION_SECTIONS)
    # every label starts a part; continuation lines stay inside the part they follow
    marked = F.regexp_replace(as_column(text), rf"(?im)^[ \t]*({heads}):", "\u0001$1:")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p.rlike(rf"(?i)^(?:{heads}):"))
    entries = F.transform(
        parts,
        lambda p: F.struct(
            F.lower(F.substring_index(p, ":", 1)).alias("key"),
            F.array_join(
                F.transform(F.split(F.regexp_replace(p, r"^[A-Za-z]+:", ""), "\n"), strip).cast("array<string>"),
                "\n",
            ).alias("value"),
        ),
    )
    joined = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.array_join(
                F.filter(
                    F.split(e["value"], "\n"), lambda line, i: (i == 0) | (line != "")
                ),
                " ",
            ).alias("value"),
        ),
    )
    last_wins = F.filter(
        joined,
        lambda e, i: ~F.exists(F.slice(joined, i + 2, F.size(joined)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(last_wins)


def image_stub_text(name: str | Column) -> Column:
    return F.concat(F.lit("[Image file: "), as_column(name), F.lit("]"))


# --- query text -------------------------------------------------------------------------------


def sanitize_query(query: str | Column) -> Column:
    """Unified search: every operator symbol becomes a blank."""
    return strip(F.regexp_replace(F.regexp_replace(as_column(query), V.QUERY_SYMBOLS, " "), SPACE_RUN, " "))


def sanitize_question(query: str | Column) -> Column:
    """Question search: ``word*`` survives, other symbols go, stop words go unless nothing is left."""
    symbols = V.QUERY_SYMBOLS.replace("*", "")
    text = F.regexp_replace(as_column(query), r"(?U)(?<!\w)\*", " ")
    text = strip(F.regexp_replace(F.regexp_replace(text, symbols, " "), SPACE_RUN, " "))
    kept = F.filter(F.split(text, " "), lambda w: ~F.lower(w).isin(V.QUERY_STOP_WORDS))
    joined = F.array_join(kept, " ")
    return F.when(joined == "", text).otherwise(joined)


def parse_planned_queries(text: str | Column) -> Column:
    """Array of query strings out of a planner reply; code fences dropped, anything else gives none."""
    text = strip(text)
    unfenced = strip(
        F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.startswith(strip(line), F.lit("```"))), "\n")
    )
    body = F.when(F.startswith(text, F.lit("```")), unfenced).otherwise(text)
    parsed = F.from_json(F.when(F.startswith(body, F.lit("[")), body), "array<string>")
    return F.coalesce(
        F.transform(F.filter(parsed, lambda q: q.isNotNull() & (q != "")), sanitize_question),
        F.array().cast("array<string>"),
    )


def year_of(text: str | Column) -> Column:
    return F.year(F.try_to_date(as_column(text)))
