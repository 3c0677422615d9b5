"""Sharding by histogram sort.

Rows get a key (a hash of the text, ties broken by the id).  Splitters that divide the bytes evenly are found by
counting: each round lays probes over the interval of every splitter, sums the exact bytes between the probes on
all partitions, and keeps the gap in which the splitter's share of all bytes lies.  Rounds end when the gap is
within the tolerance.  A text that fills a shard by itself is split by the ids below its one hash.  The rows are
exchanged once, by their place between the splitters.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ranks import numbered

#: Probes in each splitter's interval and round, and how far a splitter may miss, as a share of a mean shard.
PROBES, TOLERANCE = 256, 0.001

_LEAST = -(1 << 63)


@dataclass
class Gap:
    """Where a splitter lies: keys ``low`` up to below ``high``, and the bytes of all rows in front of ``low`` and ``high``."""

    target: float
    low: int
    high: int
    before: int
    until: int
    hash: int | None = None  # set when the gap is one hash and the ids below it are searched

    def settled(self, tolerance: float) -> bool:
        return self.until - self.before <= tolerance or (self.hash is not None and self.high - self.low <= 1)

    def splitter(self) -> tuple[int, int]:
        """The end of the gap that is nearer to the target: the first key (hash, id) of the next shard."""
        key = self.low if self.target - self.before <= self.until - self.target else self.high
        return (key, _LEAST) if self.hash is None else (self.hash, key)


def splitters(rows: DataFrame, shards: int, *, hash_: str, tie: str, size: str, probes: int = PROBES,
              tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The ``shards - 1`` first keys ``(hash, tie)`` of the shards after the first.  ``hash_`` must not be negative.

    The driver gets at most ``probes`` sums per splitter and round.  Fewer splitters come back for an empty table.
    """
    ends = rows.agg(F.min(hash_), F.max(hash_), F.min(tie), F.max(tie), F.sum(size)).first()
    if ends[4] is None:
        return []
    total = ends[4]
    gaps = [Gap(total * k / shards, ends[0], ends[1] + 1, 0, total) for k in range(1, shards)]
    limit = tolerance * total / shards
    while open_ := [g for g in gaps if not g.settled(limit)]:
        for g in open_:
            if g.hash is None and g.high - g.low <= 1:  # one hash: go on with the ids below it
                g.hash, g.low, g.high = g.low, ends[2], ends[3] + 1
        places = sorted({(g.hash, g.low, g.high) for g in open_}, key=str)
        steps = [max(1, -(-(high - low) // probes)) for _, low, high in places]
        bins = []
        for n, ((fixed, low, high), step) in enumerate(zip(places, steps, strict=True)):
            key = F.col(hash_ if fixed is None else tie)
            inside = (key >= low) & (key < high) & (F.lit(True) if fixed is None else F.col(hash_) == fixed)
            # the quotient is exact: the difference of two longs of one sign fits, and is divided as a decimal otherwise
            place = F.floor((key.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)")).cast("long")
            bins.append(F.when(inside, F.struct(F.lit(n).alias("n"), place.alias("bin"))))
        hit = rows.select(F.explode(F.array_compact(F.array(*bins))).alias("b"), F.col(size).alias("_size"))
        sums: dict[int, dict[int, int]] = {}
        for r in hit.groupBy("b").agg(F.sum("_size").alias("s")).collect():
            sums.setdefault(r["b"]["n"], {})[r["b"]["bin"]] = r["s"]
        for g in open_:
            n = places.index((g.hash, g.low, g.high))
            low, before, until = g.low, g.before, g.until
            for b, s in sorted(sums.get(n, {}).items()):
                if before + s >= g.target:
                    g.low, g.high = max(low, low + b * steps[n]), min(g.high, low + (b + 1) * steps[n])
                    g.before, g.until = before, before + s
                    break
                before += s
            else:
                g.low, g.before, g.until = g.high - 1, before, until
    return sorted(g.splitter() for g in gaps)


def shard_of(bounds: list[tuple[int, int]], hash_: str, tie: str) -> Column:
    """How many splitters are not above the row's key."""
    passed = [F.when((F.col(hash_) > h) | ((F.col(hash_) == h) & (F.col(tie) >= t)), 1).otherwise(0) for h, t in bounds]
    return sum(passed, F.lit(0)).cast("int")


def shard_rows(df: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """All rows and columns of ``df`` with ``_size``, ``_shard`` and ``_slot``: shards of nearly equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) and 1 for its end.  Equal texts lie side by side; only
    those at a border are in two shards.  ``_slot`` numbers a shard's rows from 0.  Null ids come first among equal
    texts; repeated rows stay rows of their own.  An empty table gives an empty table.
    """
    rows = df.withColumn("_size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    rows = rows.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(text), 1)).withColumn("_tie", F.coalesce(F.col(key).cast("long"), F.lit(_LEAST + 1)))
    narrow = stored(rows.select("_hash", "_tie", "_size"), "keys")
    bounds = splitters(narrow, shards, hash_="_hash", tie="_tie", size="_size")
    placed = rows.withColumn("_shard", shard_of(bounds, "_hash", "_tie"))
    return numbered(placed, "_shard", ["_hash", "_tie"], "_slot").drop("_hash", "_tie")


def write_shards(df: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", shards: int = 8) -> None:
    """``df`` in one folder per shard, rows with their ``_slot``."""
    shard_rows(df, key=key, text=text, shards=shards).write.partitionBy("_shard").parquet(folder)
