"""Names of a registry in texts: one pass over the texts, which do not move while the names are few."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .entities import GRAM

#: Bits of the bitmap that rules grams out, pieces of names that are broadcast at most, and letters that are worked on at a time.
SLOT_BITS, FEW_PIECES, SCAN_CHARS = 22, 100_000, 1_000_000


def scan_names(docs: DataFrame, names: DataFrame, *, doc_id: str = "doc_id", text: str = "text", gram: int = 8) -> DataFrame:
    """``(doc_id, person_id, name_key)`` as ``entities.direct_scan``, without a row per gram of a text.

    One piece per name (its rarest, as there) finds the candidates and ``contains`` confirms them.  A bitmap of hashed
    pieces, all that passes the driver, rules out nearly all grams of a text; only the others are made into strings and
    joined.  Up to ``FEW_PIECES`` pieces are broadcast to the texts; more meet the grams without the text, which then meets
    the candidates by id.
    """
    low = docs.select(doc_id, F.lower(text).alias("_low"))
    keep = names.filter(F.length("name_key") >= GRAM).select("name_key", "person_id")
    known = _rarest(keep.filter(F.length("name_key") >= gram), gram).unionByName(_rarest(keep.filter(F.length("name_key") < gram), GRAM))
    slots = known.select("piece").mapInArrow(_slots_of, "slot long")
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"), F.count("*").alias("n")).collect()
    schema = T.StructType([*low.schema.fields, T.StructField("_pieces", T.ArrayType(T.StringType()))])
    found = low.mapInArrow(_held_grams({r["word"]: r["bits"] for r in words}, sorted({gram, GRAM})), schema)
    if sum(r["n"] for r in words) <= FEW_PIECES:
        near = found.select(doc_id, "_low", F.explode("_pieces").alias("piece")).join(F.broadcast(known), "piece")
    else:
        candidates = found.select(doc_id, F.explode("_pieces").alias("piece")).join(known, "piece").select(doc_id, "person_id", "name_key")
        near = candidates.join(low, doc_id)
    return near.filter(F.contains("_low", "name_key")).select(doc_id, "person_id", "name_key")


def _rarest(names: DataFrame, size: int) -> DataFrame:
    """The piece of each name that the fewest names have, in whole letters."""
    runs = F.transform(F.sequence(F.lit(1), F.length("name_key") - size + 1), lambda i: F.substring(F.col("name_key"), i, F.lit(size)))
    pieces = names.select("name_key", "person_id", F.explode(F.array_distinct(runs)).alias("piece"))
    counts = pieces.groupBy("piece").agg(F.count("*").alias("_n"))
    return pieces.join(counts, "piece").groupBy("name_key", "person_id").agg(F.min_by("piece", F.struct("_n", "piece")).alias("piece"))


def _hashes(points, size: int):
    """A slot for every run of ``size`` code points, by where it begins."""
    import numpy as np

    n = max(len(points) - size + 1, 0)
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed + points[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slots_of(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        slots = [int(_hashes(_points(p), len(p))[0]) for p in batch.column("piece").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], ["slot"])


def _held_grams(words: Mapping[int, int], sizes: Sequence[int]) -> Callable[[Iterator], Iterator]:
    """Of batches ``(id, _low)`` the rows with a gram whose bit is set, and their different grams of that kind."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bitmap = np.zeros(1 << SLOT_BITS, bool)
        for word, bits in words.items():
            bitmap[word * 64:word * 64 + 64] = [bits >> i & 1 for i in range(64)]
        for batch in batches:
            rows, held = [], []
            texts = batch.column(1).to_pylist()
            lengths = np.array([len(t or "") for t in texts])
            # whole texts, worked in runs of about SCAN_CHARS
            run_of = np.cumsum(lengths) // SCAN_CHARS
            for one in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(run_of)) + 1):
                joined = "".join(texts[i] or "" for i in one)
                points, ends = _points(joined), np.cumsum(lengths[one])
                grams: dict[int, set] = {}
                for size in sizes:
                    at = np.flatnonzero(bitmap[_hashes(points, size)])
                    row = np.searchsorted(ends, at, side="right")
                    inside = at + size <= ends[row]
                    for i, a in zip(one[row[inside]].tolist(), at[inside].tolist()):
                        grams.setdefault(i, set()).add(joined[a:a + size])
                rows += sorted(grams)
                held += [list(grams[i]) for i in sorted(grams)]
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(held, pa.list_(pa.string()))], [*kept.schema.names, "_pieces"])

    return run
