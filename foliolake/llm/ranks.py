"""Gapless numbers inside groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the column ``name``: 0, 1, … in each ``group``, in ``order`` (ties in any order).

    Rows are range-partitioned once by group and order, so that a group may span many partitions.  A row's place in
    its sorted partition comes from ``monotonically_increasing_id``; the rows of the group in earlier partitions are
    added from a table of counts with at most one row per partition and one per group, which is therefore broadcast.
    """
    at, part, first, earlier = (f"_{x}_{name}" for x in ("at", "part", "first", "earlier"))
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(at, F.monotonically_increasing_id())
    rows = stored(rows, "numbered").withColumn(part, F.shiftright(at, 33))
    counts = rows.groupBy(group, part).agg(F.min(at).alias(first), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("_g"), F.col(part).alias("_p"), first, F.coalesce(before, F.lit(0)).alias(earlier))
    joined = rows.join(F.broadcast(counts), F.col(group).eqNullSafe(F.col("_g")) & (F.col(part) == F.col("_p")))
    return joined.select(*df.columns, (F.col(at) - F.col(first) + F.col(earlier)).alias(name))
