"""Costly columns worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose expressions stay where they are.

    The optimizer copies a projected expression into every filter, join condition and inferred
    null check above it; for regexes over whole texts that multiplies the work.  A generator is not
    copied, so the value is made once and only read from there on.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("_once", made).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])
