"""Tables in segments: an arrival replaces what its key had before, and nothing that was written is rewritten.

Generation ``g`` (a batch) writes a segment ``first_gen=g/last_gen=g`` of every table, one row of ``arrivals`` per key, and one row of
``tombstones`` per key that an older generation held.  Readers take all rows that no tombstone names: an anti-join with the
keys that came again, which Spark broadcasts while they are few.  Compaction writes the live rows of adjacent segments into one that covers
them.  A segment counts once its row in ``segments`` is written, which comes last, so a writer that is lost leaves nothing to be
seen and the same batch writes the same folders again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENERATION = "generation"
_OWN = ("arrivals", "tombstones")


class Store(NamedTuple):
    """Where the tables lie, their key, and how files are sorted (``cluster_by``) and put into folders (``partition_by``).

    No table moves: a task writes its own rows, with folders one file for each, so there are as many files as tasks and folders.
    Rows of ``in_order`` come from their maker as ``cluster_by`` would sort them, and are only put into folders.
    """

    folder: str
    key: str = "doc_id"
    cluster_by: Mapping[str, Sequence[str]] = {}
    partition_by: Mapping[str, str] = {}
    in_order: Sequence[str] = ()


def _known(spark: SparkSession, store: Store) -> list:
    """Rows of ``segments``: one per complete segment, with the schemas of its tables."""
    try:
        return spark.read.schema("schemas string, first_gen bigint, last_gen bigint").parquet(f"{store.folder}/segments").collect()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _visible(known: list) -> list[tuple[int, int]]:
    spans = sorted({(r["first_gen"], r["last_gen"]) for r in known})
    return [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]


def spans(spark: SparkSession, store: Store) -> list[tuple[int, int]]:
    """First and last generation of every segment that is read: complete, and covered by no other."""
    return _visible(_known(spark, store))


def _schemas(known: list) -> dict[str, T.StructType]:
    newest = max(known, key=lambda r: (r["last_gen"], -r["first_gen"]))
    return {name: T.StructType.fromJson(schema) for name, schema in json.loads(newest["schemas"]).items()}


def _read(spark: SparkSession, store: Store, name: str, schema: T.StructType, chosen: Sequence[tuple[int, int]]) -> DataFrame:
    if not chosen:
        return spark.createDataFrame([], schema)
    base = f"{store.folder}/{name}"
    paths = [f"{base}/first_gen={a}/last_gen={b}" for a, b in chosen]
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)


def _put(spark: SparkSession, store: Store, name: str, df: DataFrame, span: tuple[int, int], *, fresh: bool = False) -> DataFrame:
    """Writes one table of a segment and reads it back, so that what follows from it does not work it out again."""
    at = f"{name}/first_gen={span[0]}/last_gen={span[1]}"
    parts = [store.partition_by[name]] if name in store.partition_by else []
    order = [*parts, *(() if fresh and name in store.in_order else store.cluster_by.get(name, ()))]
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").partitionBy(*parts).parquet(f"{store.folder}/{at}")
    return _read(spark, store, name, df.schema, [span])


def _complete(spark: SparkSession, store: Store, schemas: Mapping[str, T.StructType], span: tuple[int, int]) -> None:
    row = json.dumps({name: schema.jsonValue() for name, schema in schemas.items()})
    spark.range(1).select(F.lit(row).alias("schemas")).coalesce(1).write.mode("overwrite").parquet(
        f"{store.folder}/segments/first_gen={span[0]}/last_gen={span[1]}")


def _live(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return df.join(tombstones, [key, GENERATION], "left_anti")


def live(spark: SparkSession, store: Store, name: str) -> DataFrame:
    """The rows of a table that hold now, without the number of their generation."""
    known = _known(spark, store)
    if not known:
        raise ValueError(f"no segment in {store.folder}")
    schemas, chosen = _schemas(known), _visible(known)
    dead = _read(spark, store, "tombstones", schemas["tombstones"], chosen)
    return _live(_read(spark, store, name, schemas[name], chosen), dead, store.key).drop(GENERATION)


def write(spark: SparkSession, store: Store, generation: int, sent: DataFrame, tables: Mapping[str, Callable[[dict], DataFrame]], *,
          deleted: str | None = None) -> None:
    """Writes the segment of a batch ``sent``, which has at most one row per key; rows without a key are left out.

    ``tables`` gives each table from those written before it, beginning with ``sent``; each has the key.  Keys whose ``deleted``
    is true go: they get no rows, only tombstones.  A generation written again replaces itself.
    """
    key, span = store.key, (generation, generation)
    keyed = sent.filter(F.col(key).isNotNull())
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    keyed = keyed.withColumn("_gone", gone)
    known = [r for r in _known(spark, store) if r["last_gen"] < generation]
    done = {"sent": _put(spark, store, "sent", keyed.withColumn(GENERATION, F.lit(generation).cast("long")), span)}
    arrivals = done["sent"].filter(~F.col("_gone")).select(key, GENERATION)
    if known:
        schemas, chosen = _schemas(known), _visible(known)
        before = _live(*(_read(spark, store, n, schemas[n], chosen) for n in _OWN), key)
        tombstones = before.join(done["sent"].select(key), key, "left_semi")
    else:
        tombstones = arrivals.limit(0)
    written = {n: _put(spark, store, n, df, span) for n, df in zip(_OWN, (arrivals, tombstones))}
    done["sent"] = done["sent"].filter(~F.col("_gone")).drop("_gone", GENERATION)
    for name, make in tables.items():
        df = make(done).withColumn(GENERATION, F.lit(generation).cast("long"))
        written[name] = _put(spark, store, name, df, span, fresh=True)
        done[name] = written[name].drop(GENERATION)
    _complete(spark, store, {n: df.schema for n, df in written.items()}, span)


def due(held: Sequence[tuple[int, int]], fan: int = 8) -> tuple[int, int] | None:
    """The newest ``fan`` or more adjacent segments of one size class (powers of ``fan`` generations), as one span.

    Merging them whenever there are that many keeps the number of segments logarithmic, and every row is written as often.
    """

    def size(span: tuple[int, int]) -> int:
        width, level = span[1] - span[0] + 1, 0
        while width >= fan:
            width, level = width // fan, level + 1
        return level

    run = []
    for span in sorted(held, reverse=True):
        if run and size(span) != size(run[-1]):
            break
        run.append(span)
    return (run[-1][0], run[0][1]) if len(run) >= fan else None


def compact(spark: SparkSession, store: Store, first: int, last: int) -> None:
    """One segment in place of those from ``first`` to ``last``: live rows, and tombstones of what is older than ``first``.

    The segments it covers stay on disk for readers that have opened them; they are not read any more.
    """
    known = _known(spark, store)
    schemas, visible = _schemas(known), _visible(known)
    covered = [s for s in visible if first <= s[0] and s[1] <= last]
    if not covered or (covered[0][0], covered[-1][1]) != (first, last):
        raise ValueError(f"segments {covered} do not end at {first} and {last}")
    dead = _read(spark, store, "tombstones", schemas["tombstones"], visible)
    for name in schemas:
        rows = _read(spark, store, name, schemas[name], covered)
        kept = rows.filter(F.col(GENERATION) < first) if name == "tombstones" else _live(rows, dead, store.key)
        _put(spark, store, name, kept, (first, last))
    _complete(spark, store, schemas, (first, last))
