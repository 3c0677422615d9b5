"""Work on bounded groups of rows inside tasks, and connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one key (first column, numbers) after another, from batches sorted by it."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and key != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            key = keys[a]
    if held:
        yield pa.Table.from_batches(held)


class Union:
    """Union-find over the places 0 to n - 1 of a task, by arrays; the root is the lowest place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, places: np.ndarray) -> np.ndarray:
        while True:
            above = self.parent[places]
            if (above == places).all():
                return places
            places = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def all_roots(self) -> np.ndarray:
        return self.roots(np.arange(len(self.parent)))


def _is_star(edges: DataFrame) -> bool:
    """Each child has one parent, and no parent is a child."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    per = ends.groupBy("id").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return per.where("child > 1 or (child = 1 and parent = 1)").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows ``(id, component)`` of every id with a link; the component is its smallest id.

    Alternating star contraction: every id passes the smallest neighbour on to its larger neighbours (large star),
    then its smaller neighbours come under the smallest of them (small star), until all hang directly under their
    smallest id.  Minima are aggregated before they are shuffled and joined back, so no neighbour list is ever
    gathered; each round is written to the shared folder, so rounds survive lost executors and plans stay short.
    Links of an id with itself and null ends are left out.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    while not _is_star(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        small = large.join(lowest, "u").select(F.explode(pairs).alias("p")).select("p.*").where("u <> v").distinct()
        e = stored(small, "links")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
