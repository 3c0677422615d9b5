"""Encoding repair by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import as_column


def as_misread(text: str | Column) -> Column:
    """A text as a reader shows it that takes its UTF-8 bytes for the Western single-byte code."""
    latin = F.decode(F.encode(as_column(text), "UTF-8"), "ISO-8859-1")
    return F.translate(latin, V.WESTERN_CONTROLS, V.WESTERN_LETTERS)


def fix_mojibake(text: str | Column) -> Column:
    """UTF-8 that was read as the Western single-byte code, read again the right way; else the text itself.

    Repaired are texts that have a byte for each character, whose bytes are valid UTF-8 and hold no replacement
    character.  Null stays null.
    """
    text = as_column(text)
    several = F.octet_length(text) != F.length(text)  # bytes for some character: not all of them are plain ASCII
    single = several & text.rlike(f"^[\\x00-\\x7f\\xa0-\\xff{V.WESTERN_LETTERS}]*$")
    read = F.when(single, F.encode(F.translate(text, V.WESTERN_LETTERS, V.WESTERN_CONTROLS), "ISO-8859-1").cast("string"))
    # a lambda's argument is worked out once, however often it is read
    valid = F.transform(F.array(read), lambda raw: F.when(F.is_valid_utf8(raw) & ~F.contains(raw, F.lit("\ufffd")), raw))
    return F.coalesce(F.element_at(valid, 1), text)
