"""Co-occurrence graphs over documents, flights, mails and entity mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import noise

SLICE = 2000
#: Links of one task where they are paired: few bytes, but many pairs.
TASK_LINKS = 250_000


def weighted_pairs(links: DataFrame, group: str, item: str, n: str, *, slice_rows: int = SLICE, tasks: int | None = None) -> DataFrame:
    """``(source, target, weight)`` with weight = sum over groups of n(source) * n(target), source < target.

    ``links`` has one row per (group, item).  A group of more than ``slice_rows`` items is cut into
    slices: each slice of its items meets the group's items in a task of its own, so a hot group is
    spread, and the sum is combined before its shuffle.  Nothing is left out.  ``tasks`` is the number of tasks that pair;
    without it Spark goes by the bytes of the links, which are few beside the memory their pairs take.
    """
    if tasks:
        links = links.repartition(tasks, group)
    sizes = links.groupBy(group).agg(F.count("*").alias("_size")).filter(F.col("_size") > 1)
    sized = links.join(sizes, group).withColumn("_slices", F.ceil(F.col("_size") / slice_rows).cast("int"))
    left = sized.select(group, F.col(item).alias("source"), F.col(n).alias("_n1"),
                        F.pmod(F.xxhash64(item), F.col("_slices")).cast("int").alias("_slice"))
    right = sized.select(group, F.col(item).alias("target"), F.col(n).alias("_n2"),
                         F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
    if tasks:
        left, right = (side.repartition(tasks, group, "_slice") for side in (left, right))
    return (
        left.join(right, [group, "_slice"])
        .filter(F.col("source") < F.col("target"))
        .groupBy("source", "target")
        .agg(F.sum(F.col("_n1") * F.col("_n2")).alias("weight"))
    )


def cooccurrence(links: DataFrame, group: str, item: str, *, weight: float = 1.0, kind: str = "co-occurrence") -> DataFrame:
    """Edges between items that share a group, ``weight`` per shared group."""
    once = links.select(group, item).filter(F.col(item).isNotNull()).distinct().withColumn("_one", F.lit(1))
    least = int(once.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = weighted_pairs(once, group, item, "_one", tasks=max(least, 1 + once.count() // TASK_LINKS))
    return pairs.select("source", "target", F.lit(kind).alias("type"), (F.col("weight") * F.lit(float(weight))).alias("weight"))


def document_edges(document_persons: DataFrame, *, doc: str = "doc_id", person: str = "person_id") -> DataFrame:
    return cooccurrence(document_persons, doc, person, weight=V.EDGE_WEIGHTS["co-occurrence"])


def flight_edges(flights: DataFrame, *, flight: str = "flight_id", passengers: str = "passenger_ids", pilots: str = "pilot_ids") -> DataFrame:
    aboard = flights.select(flight, F.explode(F.array_union(passengers, pilots)).alias("person_id"))
    return cooccurrence(aboard, flight, "person_id", weight=V.EDGE_WEIGHTS["co-passenger"], kind="co-passenger")


def mail_edges(mails: DataFrame, *, mail: str = "mail_id", persons: str = "person_ids") -> DataFrame:
    named = mails.select(mail, F.explode(persons).alias("person_id"))
    return cooccurrence(named, mail, "person_id", weight=V.EDGE_WEIGHTS["correspondence"], kind="correspondence")


def merge_edges(*edges: DataFrame, attribute: str | None = None, order: str | None = None) -> DataFrame:
    """Edges keyed by ordered endpoints and type, weights summed; a later attribute replaces an earlier one."""
    union = edges[0]
    for more in edges[1:]:
        union = union.unionByName(more, allowMissingColumns=True)
    keyed = union.withColumn("_s", F.least("source", "target")).withColumn("_t", F.greatest("source", "target"))
    aggs = [F.sum("weight").alias("weight")]
    if attribute:
        aggs.append(F.max_by(attribute, order or attribute).alias(attribute))
    return keyed.groupBy(F.col("_s").alias("source"), F.col("_t").alias("target"), "type").agg(*aggs)


def person_nodes(links: DataFrame, labels: DataFrame | None = None, *, person: str = "person_id") -> DataFrame:
    """One node per person; the registry's name replaces the id where there is one. ``labels(person_id, name)``."""
    nodes = links.select(F.col(person).alias("id")).filter("id is not null").distinct()
    if labels is None:
        return nodes.select("id", F.col("id").cast("string").alias("label"), F.lit("person").alias("type"))
    named = nodes.join(labels.select(F.col("person_id").alias("id"), "name"), "id", "left")
    return named.select("id", F.coalesce("name", F.col("id").cast("string")).alias("label"), F.lit("person").alias("type"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("node_count")).select(
        "node_count", edges.agg(F.count("*").alias("n")).scalar().alias("edge_count"))


# --- views ------------------------------------------------------------------------------------


def top_persons(persons: DataFrame, document_persons: DataFrame, *, limit: int = 200) -> DataFrame:
    """``(person_id, name, category, mentions)`` of the most linked persons; ties by id."""
    counts = document_persons.groupBy("person_id").agg(F.count("*").alias("mentions"))
    return persons.join(counts, "person_id").orderBy(F.desc("mentions"), "person_id").limit(limit)


def top_edges(edges: DataFrame, limit: int) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "source", "target").limit(limit)


def between(edges: DataFrame, nodes: DataFrame, *, node: str = "id") -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col(node).alias("_id"))
    return edges.join(ids, edges["source"] == F.col("_id"), "left_semi").join(ids, edges["target"] == F.col("_id"), "left_semi")


def registry_graph_edges(persons: DataFrame, document_persons: DataFrame, *, limit: int = 200, edge_limit: int = 500) -> DataFrame:
    """The heaviest edges between the most linked persons; nobody else is paired."""
    nodes = top_persons(persons, document_persons, limit=limit).select("person_id")
    pairs = cooccurrence(document_persons.join(nodes, "person_id", "left_semi"), "doc_id", "person_id")
    return top_edges(pairs.select("source", "target", "weight"), edge_limit)


def entity_key(entity_type: str = "entity_type", text: str = "text") -> Column:
    return F.concat(F.col(entity_type), F.lit(":"), F.lower(text))


def mention_nodes(mentions: DataFrame, *, limit: int = 200, minimum: int = 5, types: Sequence[str] = ("PERSON", "ORG")) -> DataFrame:
    """Entities with enough mentions, by distinct documents; the shown name is the smallest spelling."""
    kept = mentions.filter(F.col("entity_type").isin(list(types)) & noise.graph_nodes("text"))
    per_document = kept.groupBy(entity_key().alias("id"), "doc_id").agg(
        F.count("*").alias("n"), F.min(F.struct("text", "entity_type")).alias("first"))
    return (
        per_document.groupBy("id")
        .agg(F.sum("n").alias("n"), F.count("*").alias("mentions"), F.min("first").alias("first"))
        .filter(F.col("n") >= minimum)
        .select("id", F.col("first.text").alias("name"), F.lower("first.entity_type").alias("type"), "mentions")
        .orderBy(F.desc("mentions"), "id")
        .limit(limit)
    )


def mention_counts(mentions: DataFrame, *, types: Sequence[str] = ("PERSON", "ORG")) -> DataFrame:
    kept = mentions.filter(F.col("entity_type").isin(list(types)) & noise.graph_edges("text"))
    return kept.groupBy("doc_id", entity_key().alias("id")).agg(F.count("*").alias("n"))


def heavy_enough(counts: DataFrame, minimum: int) -> DataFrame:
    """Drops entities that no partner can lift to ``minimum``.

    The weight of a pair is at most the sum over documents of n(entity) times the largest other
    count there, so an entity whose bound is below the minimum is in no reported pair.  In a
    document full of names that occur nowhere else this removes nearly all of them.
    """
    best = counts.groupBy("doc_id").agg(
        F.max(F.struct("n", "id")).alias("top"), F.count("*").alias("_k"))
    bound = counts.join(best.filter("_k > 1"), "doc_id").groupBy("id").agg(
        F.sum(F.col("n") * F.col("top.n")).alias("bound")).filter(F.col("bound") >= minimum)
    return counts.join(bound.select("id"), "id", "left_semi")


def mention_edges(mentions: DataFrame, *, minimum: int = 3, types: Sequence[str] = ("PERSON", "ORG"), nodes: DataFrame | None = None) -> DataFrame:
    """Entity pairs by mention pairs inside a document, weight >= ``minimum``.

    Mentions are counted per (document, entity) before the self-join: the weight of a pair is the
    sum of the products of its counts, the same number as pairing the mentions one by one.  With
    ``nodes(id)`` only entities among them are paired.
    """
    counts = mention_counts(mentions, types=types)
    if nodes is not None:
        counts = counts.join(nodes.select("id"), "id", "left_semi")
    counts = heavy_enough(counts, minimum)
    return weighted_pairs(counts, "doc_id", "id", "n").filter(F.col("weight") >= minimum)


def mention_graph_edges(mentions: DataFrame, *, limit: int = 200, edge_limit: int = 400) -> DataFrame:
    """The heaviest edges between the nodes of the view."""
    return top_edges(mention_edges(mentions, nodes=mention_nodes(mentions, limit=limit)), edge_limit)
