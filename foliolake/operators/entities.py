"""Entity mentions and their links to a person registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.similarity import indel_ratio, sorted_words
from ..functions.spans import find_spans
from ..functions.text import normalise
from .similar import similar_pairs

GRAM = 3


# --- mentions ---------------------------------------------------------------------------------


def regex_entities(docs: DataFrame, *, text: str = "text", types: Sequence[str] | None = None,
                   patterns: Mapping[str, str] | None = None) -> DataFrame:
    """Mentions by pattern with offsets; ``types`` picks some, ``["all"]`` or None takes every pattern."""
    patterns = dict(patterns or V.ENTITY_PATTERNS)
    if types is not None and "all" not in types:
        patterns = {k: p for k, p in patterns.items() if k in types}
    keys = [c for c in docs.columns if c != text]
    if not patterns:
        return docs.limit(0).select(*keys, F.lit("").alias("entity_type"), F.lit("").alias("text"),
                                    F.lit(0).alias("start"), F.lit(0).alias("end"))
    spans = find_spans(docs, text, patterns, type_column="entity_type")
    return spans.select(*keys, "entity_type", F.col("match").alias("text"), "start", "end")


def gazetteer_entities(docs: DataFrame, gazetteer: DataFrame, *, text: str = "text") -> DataFrame:
    """Capitalised words that a gazetteer ``(surface, entity_type)`` knows.  The join size decides its own strategy."""
    keys = [c for c in docs.columns if c != text]
    words = docs.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{Ll}]+"), F.lit(0))).alias("text"))
    return words.join(gazetteer.select(F.col("surface").alias("text"), "entity_type"), "text").select(*keys, "entity_type", "text")


def tagged_entities(docs: DataFrame, tagger: Callable[[], Callable[[list[str]], list[list[tuple]]]], *, text: str = "text",
                    slice_chars: int = 1_000_000) -> DataFrame:
    """Mentions from any tagger, made once per task by ``tagger()``; long texts go in slices of one million.

    The tagger maps a list of texts to lists of ``(entity_type, text, start, end)``.
    """
    keys = [c for c in docs.columns if c != text]
    n_slices = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / slice_chars).cast("int") - 1, F.lit(0)))
    slices = docs.select(*keys, F.explode(n_slices).alias("_slice"), F.col(text)).withColumn(
        text, F.substring(F.col(text), F.col("_slice") * slice_chars + 1, F.lit(slice_chars))
    ).drop("_slice")
    schema = docs.select(*keys).schema.add("entity_type", "string").add("text", "string").add("start", "integer").add("end", "integer")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        tag = tagger()
        for frame in frames:
            rows = []
            for head, found in zip(frame[keys].itertuples(index=False), tag(frame[text].tolist())):
                rows += [(*head, *mention) for mention in found]
            yield pd.DataFrame(rows, columns=[*keys, "entity_type", "text", "start", "end"])

    return slices.mapInPandas(run, schema)


# --- registry ---------------------------------------------------------------------------------


def registry_names(persons: DataFrame) -> DataFrame:
    """``(name_key, person_id, is_alias, ord)`` from ``persons(person_id, name, aliases, ord)``.

    A later entry takes over a name key; ``ord`` keeps the order of first appearance for ties.
    """
    listed = persons.select(
        "person_id", "ord",
        F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_nth", "_name"),
    ).select("person_id", normalise("_name").alias("name_key"), (F.col("_nth") > 0).alias("is_alias"),
             F.struct("ord", "_nth").alias("_at"))
    return listed.groupBy("name_key").agg(
        F.max_by("person_id", "_at").alias("person_id"),
        F.max_by("is_alias", "_at").alias("is_alias"),
        F.min("_at").alias("first_at"),
    )


def match_exact(mentions: DataFrame, names: DataFrame, *, text: str = "text") -> DataFrame:
    """Mentions whose normalised text is a registry name."""
    return mentions.withColumn("name_key", normalise(text)).join(names.select("name_key", "person_id"), "name_key")


def fuzzy_names(keys: DataFrame, names: DataFrame, *, threshold: float) -> DataFrame:
    """Best registry name per distinct name key by token-sort ratio, the earliest name on ties.

    Candidates come from shared pieces of the two strings (see ``similar_pairs``), which loses no
    pair at or above the threshold, so there is no cross join.
    """
    left = keys.select("name_key", sorted_words("name_key").alias("_l"))
    right = names.select("person_id", "first_at", F.col("name_key").alias("matched_name"),
                         sorted_words("name_key").alias("_r"))
    pairs = similar_pairs(
        left.select(F.col("name_key").alias("id"), F.col("_l").alias("value")),
        right.select(F.col("matched_name").alias("id"), F.col("_r").alias("value")),
        threshold=threshold,
    )
    scored = pairs.select(F.col("left_id").alias("name_key"), F.col("right_id").alias("matched_name"), "score").join(
        right.select("matched_name", "person_id", "first_at"), "matched_name")
    best = scored.groupBy("name_key").agg(F.max("score").alias("score"),
                                          F.min_by(F.struct("person_id", "matched_name"),
                                                   F.struct((-F.col("score")).alias("s"), "first_at")).alias("_m"))
    return best.select("name_key", F.col("_m.person_id").alias("person_id"), F.col("_m.matched_name").alias("matched_name"), "score")


def link_persons(mentions: DataFrame, names: DataFrame, *, text: str = "text", threshold: int = 85) -> DataFrame:
    """Every mention with ``person_id`` (NULL when nothing matches): exact name first, then the best fuzzy one."""
    keyed = mentions.withColumn("name_key", normalise(text))
    exact = names.select("name_key", F.col("person_id").alias("_exact"))
    unknown = keyed.select("name_key").distinct().join(exact, "name_key", "left_anti")
    fuzzy = fuzzy_names(unknown, names, threshold=threshold / 100).select("name_key", F.col("person_id").alias("_fuzzy"))
    lookup = exact.select("name_key", F.col("_exact").alias("person_id")).unionByName(
        fuzzy.select("name_key", F.col("_fuzzy").alias("person_id")))
    return keyed.join(lookup, "name_key", "left").drop("name_key")


def score_mentions(mentions: DataFrame, names: DataFrame, *, text: str = "text") -> DataFrame:
    """Match confidence per mention: 1.0 name, 0.95 alias, 0.85 / 0.75 for a fuzzy 95 / 90; others are dropped."""
    keyed = mentions.withColumn("name_key", normalise(text)).filter(F.length("name_key") >= 3)
    exact = names.select(
        "name_key", "person_id",
        F.when(F.col("is_alias"), 0.95).otherwise(1.0).alias("confidence"),
        F.when(F.col("is_alias"), "alias").otherwise("exact").alias("match_type"),
        F.col("name_key").alias("matched_name"),
    )
    unknown = keyed.select("name_key").distinct().join(exact, "name_key", "left_anti")
    fuzzy = fuzzy_names(unknown, names, threshold=0.90).select(
        "name_key", "person_id", F.when(F.col("score") >= 0.95, 0.85).otherwise(0.75).alias("confidence"),
        F.lit("fuzzy").alias("match_type"), "matched_name",
    )
    return keyed.join(exact.unionByName(fuzzy), "name_key").drop("name_key")


def link_confidence(signals: Mapping[str, Column]) -> Column:
    """Sum of the weights of the signals that hold, at most 1; unknown signals count nothing."""
    total = F.lit(0.0)
    for name, weight in V.SIGNAL_WEIGHTS.items():
        if name in signals:
            total = total + F.when(signals[name], F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def direct_scan(docs: DataFrame, names: DataFrame, *, doc_id: str = "doc_id", text: str = "text", gram: int = 8) -> DataFrame:
    """``(doc_id, person_id, name_key)`` for each name (3+ characters) that is a substring of a text, ignoring case.

    A text that holds a name holds each piece of it, so one piece per name (its rarest) finds the
    candidates by an equi-join and ``contains`` confirms them.  Names shorter than ``gram`` use
    pieces of three.  All grams of a text come from one look-ahead regex, in linear time; they travel
    without the text, which meets only the candidates, by id.
    """
    low = docs.select(doc_id, F.lower(text).alias("_low"))
    keep = names.filter(F.length("name_key") >= GRAM).select("name_key", "person_id")
    candidates = None
    for size, part in ((gram, keep.filter(F.length("name_key") >= gram)), (GRAM, keep.filter(F.length("name_key") < gram))):
        grams = F.array_distinct(F.regexp_extract_all("_low", F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))
        pieces = low.select(doc_id, F.explode(grams).alias("piece"))
        near = pieces.join(_rarest_pieces(part, size), "piece").select(doc_id, "person_id", "name_key")
        candidates = near if candidates is None else candidates.unionByName(near)
    return candidates.join(low, doc_id).filter(F.contains("_low", "name_key")).select(doc_id, "person_id", "name_key")


def _rarest_pieces(names: DataFrame, size: int) -> DataFrame:
    pieces = names.select("name_key", "person_id", F.explode(F.array_distinct(
        F.regexp_extract_all("name_key", F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))).alias("piece"))
    counts = pieces.groupBy("piece").agg(F.count("*").alias("_n"))
    return pieces.join(counts, "piece").groupBy("name_key", "person_id").agg(
        F.min_by("piece", F.struct("_n", "piece")).alias("piece"))


def document_persons(linked: DataFrame, scanned: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Distinct (document, person) from linked mentions and the direct scan together."""
    return (
        linked.filter(F.col("person_id").isNotNull()).select(doc_id, "person_id")
        .unionByName(scanned.select(doc_id, "person_id"))
        .distinct()
    )


def mention_rows(mentions: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Store rows: one per mention with the fixed confidence; duplicates stay."""
    person = F.col("person_id") if "person_id" in mentions.columns else F.lit(None)
    return mentions.select(
        F.col(doc_id).alias("document_id"), "entity_type", "text",
        F.lit(V.ENTITY_CONFIDENCE).alias("confidence"), person.alias("person_id"),
    )


__all__ = [
    "regex_entities", "gazetteer_entities", "tagged_entities", "registry_names", "match_exact", "fuzzy_names",
    "link_persons", "score_mentions", "link_confidence", "direct_scan", "document_persons", "mention_rows",
    "indel_ratio",
]
