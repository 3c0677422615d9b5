"""Packing into length buckets.

The global histogram of lengths is a sum over all rows; dynamic programming over it finds the bucket boundaries
with the least padding when every row is padded to the longest of its bucket.  Inside a bucket, rows in order of
length fill batches up to a token budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered

#: Buckets, and padded tokens of a batch.
BUCKETS, BUDGET = 16, 65_536
#: Lengths up to ``2 ** FINE`` are told apart; longer ones in ``2 ** (FINE - 1)`` steps per doubling.  The histogram
#: has at most ``2 ** FINE`` and so many rows more per doubling, whatever the input.
FINE = 14


def best_boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Padded lengths of the buckets with the least padding, rising.

    ``cells``: (longest length, rows, tokens) by rising length.  With ``rows`` and ``tokens`` summed up to cell j, a
    bucket over cells i + 1 to j costs ``length[j] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])``.  For each j the
    best i is the lowest of lines in ``length[j]`` whose slopes fall with i, so a moving hull finds it: O(buckets * cells).
    """
    if not cells:
        return []
    lengths = [c[0] for c in cells]
    rows, tokens = [0], [0]
    for _, n, t in cells:
        rows.append(rows[-1] + n)
        tokens.append(tokens[-1] + t)
    m = len(cells)
    cost = [0.0] + [float("inf")] * m
    choices = []
    for _ in range(min(buckets, m)):
        new, choice = [float("inf")] * (m + 1), [0] * (m + 1)
        hull: list[tuple[int, float, int]] = []  # lines (slope, height, i)
        head = 0
        for j in range(1, m + 1):
            i = j - 1
            if cost[i] < float("inf"):
                line = (-rows[i], cost[i] + tokens[i], i)
                while len(hull) - head >= 2 and _above(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                slope, height, i = hull[head]
                new[j], choice[j] = slope * x + height + x * rows[j] - tokens[j], i
        cost = new
        choices.append(choice)
    ends, j = [], m
    for choice in reversed(choices):
        ends.append(lengths[j - 1])
        j = choice[j]
    return ends[::-1]


def _above(a: tuple, b: tuple, c: tuple) -> bool:
    """The middle of three lines with falling slopes is nowhere the lowest."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def histogram(df: DataFrame, length: str) -> list[tuple[int, int, int]]:
    """(longest length, rows, tokens) of each cell of lengths, over all rows."""
    exponent = F.greatest(F.floor(F.log2(F.greatest(F.col(length), F.lit(1)))).cast("int") - FINE + 1, F.lit(0))
    cell = F.call_function("shiftright", F.col(length), exponent)
    cells = df.select(F.col(length).alias("l"), exponent.alias("e"), cell.alias("c")).groupBy("e", "c").agg(
        F.max("l").alias("longest"), F.count("*").alias("n"), F.sum("l").alias("tokens")).orderBy("longest").collect()
    return [(r["longest"], r["n"], r["tokens"]) for r in cells]


def pack(df: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Rows ``(key, n_tokens, bucket, padded_tokens, batch, slot)``, one per input row.

    Tokens are what lies between white space; null and empty texts have none.  A batch holds
    ``max(1, budget // padded_tokens)`` rows of one bucket: a row longer than the budget is a batch of its own.
    Batches are numbered from 0 in each bucket, slots from 0 in each batch; rows of one length are ordered by key
    (ties in any order).  Other columns are left out.
    """
    rows = df.select(F.col(key).alias("_id"), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens"))
    ends = best_boundaries(histogram(rows, "n_tokens"), buckets)
    if not ends:
        ends = [0]
    bucket = sum((F.when(F.col("n_tokens") > end, 1).otherwise(0) for end in ends[:-1]), F.lit(0)).cast("int")
    dealt = numbered(rows.withColumn("bucket", bucket), "bucket", ["n_tokens", "_id"], "_rank")
    padded = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(budget / F.greatest(padded, F.lit(1)))).cast("long")
    return dealt.select(F.col("_id").alias(key), "n_tokens", "bucket", padded.alias("padded_tokens"),
                        F.floor(F.col("_rank") / room).cast("long").alias("batch"), (F.col("_rank") % room).alias("slot"))
