"""Entity noise filters: five presets made from the same small rules, each a boolean ``Column``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import as_column

STOP_LISTS = {
    "directory": ["nan", "null", *V.HEADER_WORDS, *V.COMPANY_AND_TITLE_WORDS, *V.MAIL_FOOTERS, *V.FEED_PHRASES,
                  *V.LONE_FIRST_NAMES, *V.PANDEMIC_WORDS, *V.PLACE_STUBS],
    "graph_nodes": ["nan", "null", *V.HEADER_WORDS, *V.COMPANY_AND_TITLE_WORDS, *V.FEED_PHRASES, *V.LONE_FIRST_NAMES,
                    *V.PANDEMIC_WORDS, *V.PLACE_STUBS, *V.SHIPPING_WORDS, *V.SHIPPING_PHRASES],
    "project": [*V.HEADER_WORDS, *V.POSTSCRIPT_WORDS, *[w for w in V.COMPANY_AND_TITLE_WORDS if w != "html"]],
    "case": [*V.HEADER_WORDS, *V.COMPANY_AND_TITLE_WORDS, *V.POSTSCRIPT_WORDS, *V.FEED_PHRASES, *V.LONE_FIRST_NAMES,
             *V.PANDEMIC_WORDS],
    "case_person": [*V.PLACE_STUBS, *V.SHIPPING_WORDS],
}
CSS_UNIT = r"[0-9](?:px|em|%)$"


def _any_of(literals: list[str]) -> str:
    return "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", x) for x in literals)


def _ends_with_word(words: list[str]) -> str:
    return f" (?:{_any_of(words)})$"


def directory(text: str | Column = "text") -> Column:
    text = as_column(text)
    bare = F.trim(text)
    return (
        (F.length(bare) > 2)
        & ~F.lower(text).isin(STOP_LISTS["directory"])
        & ~text.rlike(_ends_with_word(V.ADDRESS_SUFFIXES))
        & ~text.rlike(_any_of([*V.DIRECTORY_SYMBOLS, "]("]))
        & ~text.rlike(CSS_UNIT)
        & ~text.rlike(r"[\r\n]")
        & ~(text.rlike("^[0-9]") & (F.length(bare) < 4))
        & bare.rlike("[A-Za-z]")
    )


def graph_nodes(text: str | Column = "text") -> Column:
    text = as_column(text)
    bare = F.trim(text)
    return (
        (F.length(bare) > 2)
        & ~F.lower(text).isin(STOP_LISTS["graph_nodes"])
        & ~text.rlike(_ends_with_word(["Ave", "St", "Blvd", "Rd", "N.", "S."]))
        & ~text.rlike(_any_of(V.GRAPH_NODE_SYMBOLS))
        & ~text.rlike(CSS_UNIT)
        & ~text.rlike(r"[\r\n]")
        & bare.rlike("[a-z]")
        & ~(text.rlike("^[0-9]") & (F.length(bare) < 5))
    )


def graph_edges(text: str | Column = "text") -> Column:
    text = as_column(text)
    return (F.length(F.trim(text)) >= 3) & ~text.rlike(_any_of(V.GRAPH_EDGE_SYMBOLS))


def project(text: str | Column = "text") -> Column:
    text = as_column(text)
    return (
        (F.length(text) > 1)
        & (F.length(text) < 60)
        & ~F.lower(text).isin(STOP_LISTS["project"])
        & ~text.rlike(r"(?s)[0-9].*[0-9].*[0-9]")
    )


def case(text: str | Column = "text") -> Column:
    text = as_column(text)
    return (
        (F.length(F.trim(text)) > 2)
        & ~text.rlike(r"[\r\n]")
        & ~text.rlike(_any_of([">", "<", "@", "]("]))
        & ~F.lower(text).isin(STOP_LISTS["case"])
        & ~text.rlike(r"(?s)[0-9].*[0-9].*[0-9]")
    )


def case_person(text: str | Column = "text") -> Column:
    text = as_column(text)
    return (
        case(text)
        & ~text.rlike(_ends_with_word(V.ADDRESS_SUFFIXES))
        & ~F.lower(text).isin(STOP_LISTS["case_person"])
        & F.trim(text).rlike("[a-z]")
    )


PRESETS = {
    "directory": directory,
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "project": project,
    "case": case,
    "case_person": case_person,
}


def noise_filter(preset: str, text: str | Column = "text") -> Column:
    return PRESETS[preset](text)


def location(text: str | Column = "text", entity_type: str | Column = "entity_type") -> Column:
    text = as_column(text)
    return (
        as_column(entity_type).isin(V.LOCATION_ENTITY_TYPES)
        & ~F.lower(text).isin("nan", "null")
        & (F.length(F.trim(text)) > 1)
        & ~text.rlike(r"[{}]")
    )


def entity_type_filter(wanted: str | None, entity_type: str | Column = "entity_type") -> Column:
    """An explicit type ignores case; without one the numeric and temporal types are left out."""
    entity_type = as_column(entity_type)
    if wanted:
        return F.upper(entity_type) == wanted.upper()
    return ~entity_type.isin(V.NUMERIC_ENTITY_TYPES)
