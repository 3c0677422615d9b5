"""Writing the case store and its reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, key: Sequence[str], arrival: str, *, policy: str) -> DataFrame:
    """One row per key: ``replace`` keeps the last arrival, ``ignore`` the first.

    An aggregate, not a window: a key that arrives again and again is reduced before the shuffle.
    Of rows with one arrival a hash of the row decides, so the choice is the same in every run.
    """
    pick = {"replace": F.max_by, "ignore": F.min_by}[policy]
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(arrival, F.xxhash64(*rest))).alias("_row")).select(*key, "_row.*")


def drop_orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def write_store(tables: Mapping[str, DataFrame], folder: str, *, cluster_by: Mapping[str, Sequence[str]] | None = None,
                partition_by: Mapping[str, str] | None = None) -> None:
    """Full rebuild of the store: each table sorted by its lookup key inside its files.

    Range partitioning on (key, …) keeps file statistics tight for point lookups, and a hot key
    still spreads when further columns follow it.  A column in ``partition_by`` becomes folders that
    a filter on it prunes; range partitioning in front of it keeps the number of files near that of tasks.
    """
    for name, df in tables.items():
        folders = [(partition_by or {})[name]] if name in (partition_by or {}) else []
        order = [*folders, *(cluster_by or {}).get(name, ())]
        out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        out.write.mode("overwrite").partitionBy(*folders).parquet(f"{folder}/{name}")


def save_tables(tables: Mapping[str, DataFrame], database: str) -> None:
    """The same as catalog tables, analysed for the optimizer."""
    for name, df in tables.items():
        full = f"{database}.{name}"
        df.write.mode("overwrite").saveAsTable(full)
        df.sparkSession.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS")


def save_bucketed(tables: Mapping[str, DataFrame], folder: str, *, by: Sequence[str], buckets: int, prefix: str) -> dict[str, str]:
    """Tables ``<prefix>_<name>`` in as many buckets by the same key, sorted inside: they join on the key without an exchange.

    Files lie in ``folder``; the catalog keeps the buckets and the analysed sizes.  Rows of one key share a file, so the key must
    be one that no share of all rows holds.  Gives the names of the tables.
    """
    names = {}
    for name, df in tables.items():
        full = names[name] = f"{prefix}_{name}"
        df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).option("path", f"{folder}/{name}").saveAsTable(full)
        df.sparkSession.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS")
    return names


def write_json(df: DataFrame, folder: str) -> None:
    """Reports and chunk exports: newline-delimited JSON, one file per task."""
    df.write.mode("overwrite").json(folder)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Node and link tables; links carry no attributes."""
    write_json(nodes, f"{folder}/nodes")
    write_json(edges.select("source", "target", "type", "weight"), f"{folder}/links")
