"""SimHash near-duplicates by tiled exact comparison.

Every pair of different fingerprints is either compared or ruled out by population counts: the counts of two
fingerprints, and of equal parts of them, cannot differ by more than the fingerprints do.  Fingerprints are dealt
into blocks by population count; block pairs whose counts are further apart than the radius never meet.  Inside a
pair, tiles of a few hundred fingerprints are skipped by the ranges of the counts of their four quarters, and the
rest is compared by exclusive-or and bit counts.  The work grows with the square of the number of different
fingerprints; the rows moved grow with that square over the block size.

``similar_documents`` takes such pairs as candidates only and counts the common shingles of each candidate group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bounded
from .common import map_rows, stored
from .groups import Union, components, grouped

#: Fingerprints that meet in one task at a time, those packed into one row, and those of a tile.
BLOCK, PACK, TILE = 131_072, 4_096, 256
#: Bins of a shingle sketch, one byte each.
BINS = 64
#: Documents whose shingles are compared in one task at a time, and shingles counted in one matrix product.
GROUP, SHINGLES = 256, 4_096
#: How far below the similarity the estimate of a candidate's sketches may lie: five standard errors at 0.8.
SLACK = 0.25


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included.

    Words are what lies between ASCII white space, with A-Z in lower case; fewer words are one shingle.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    view = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.append(0, ends[:-1] + 1)[:max(1, len(parts) - words + 1)]
    stops = ends[words - 1:] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist())


def sketch(hashes: np.ndarray) -> bytes:
    """One byte of the smallest hash in each of ``BINS`` bins, 0 for an empty bin: equal bins estimate the shingles' similarity."""
    least = np.full(BINS, 2 ** 64 - 1, np.uint64)
    np.minimum.at(least, (hashes % BINS).astype(np.int64), hashes // BINS)
    return np.where(least == 2 ** 64 - 1, 0, least % 255 + 1).astype(np.uint8).tobytes()


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, seed: int = 42,
                 sketches: bool = False) -> DataFrame:
    """Rows ``(key, fp long)``, with ``sketch binary`` if asked for: the 64 bits of each whole text, as a signed number.

    Null and empty texts have 0 and an empty sketch.  One row per input row; other columns are left out.
    """
    def make():
        def work(batch):
            found, kept = [], []
            for some in bounded(batch.column(1).to_pylist()):
                for t in some:
                    hashes = shingle_hashes(t, words, seed)
                    found.append(fingerprint(hashes))
                    if sketches:
                        kept.append(sketch(hashes))
            own = [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))]
            return [*own, (kept, pa.binary())] if sketches else own
        return work

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, text), f"`{key}` {kind}, fp long" + ", sketch binary" * sketches, make)


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps >> np.uint64(16 * k) & np.uint64(0xFFFF)) for k in range(4)], axis=1).astype(np.int16)


class Tiles:
    """Fingerprints in the order of their quarters' population counts, cut into tiles with the counts' ranges."""

    def __init__(self, fps: np.ndarray, ids: np.ndarray, sketches: np.ndarray | None):
        counts = _quarters(fps)
        order = np.lexsort(counts.T[::-1])
        self.fps, self.ids, counts = fps[order], ids[order], counts[order]
        self.sketches = None if sketches is None else sketches[order]
        self.at = np.arange(0, len(fps), TILE)
        self.low, self.high = np.minimum.reduceat(counts, self.at), np.maximum.reduceat(counts, self.at)


def close_pairs(a: Tiles, b: Tiles, radius: int, similarity: float | None = None):
    """Places (in ``a`` and ``b``) of fingerprints at most ``radius`` bits apart, tile pair by tile pair.

    With sketches, pairs whose estimated share of common shingles is below ``similarity`` are left out.
    """
    same = a is b
    for i, start in enumerate(a.at.tolist()):
        gap = np.maximum(np.maximum(b.low - a.high[i], a.low[i] - b.high), 0).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        left = a.fps[start:start + TILE, None]
        for j in near[near >= i].tolist() if same else near.tolist():
            begin = int(b.at[j])
            x, y = np.nonzero(np.bitwise_count(left ^ b.fps[None, begin:begin + TILE]) <= radius)
            x, y = x + start, y + begin
            if same:
                x, y = x[x < y], y[x < y]
            if len(x) and a.sketches is not None:
                p, q = a.sketches[x], b.sketches[y]
                alike = ((p == q) & (p > 0)).sum(axis=1) >= similarity * np.maximum(1, ((p > 0) | (q > 0)).sum(axis=1))
                x, y = x[alike], y[alike]
            if len(x):
                yield x, y


def _blocks(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """Neighbouring population counts together up to ``BLOCK`` fingerprints, larger ones in several parts: (low, high, parts)."""
    out: list[list[int]] = []
    for ones, n in sorted(sizes.items()):
        if out and out[-1][2] + n <= BLOCK:
            out[-1][1:] = [ones, out[-1][2] + n]
        else:
            out.append([ones, ones, n])
    return [(low, high, -(-n // BLOCK)) for low, high, n in out]


def class_links(classes: DataFrame, radius: int, similarity: float | None) -> DataFrame:
    """Rows ``(a, b)`` that join up the ids of all rows ``(fp, id[, sketch])`` at most ``radius`` bits apart.

    With a ``similarity``, only pairs whose sketches agree to that share count.
    """
    ones = classes.withColumn("ones", F.bit_count("fp"))
    sizes = {r["ones"]: r["n"] for r in ones.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    groups = _blocks(sizes) or [(0, 64, 1)]
    low, high, parts = (F.array(*[F.lit(g[k]) for g in groups]) for k in range(3))
    number = F.element_at(F.array(*[F.lit(max([i for i, g in enumerate(groups) if g[0] <= k], default=0)) for k in range(65)]), F.col("ones") + 1)
    dealt = ones.withColumn("i", number).withColumn("part", F.pmod(F.xxhash64("fp", "id"), F.element_at(parts, F.col("i") + 1)))
    # rows are packed a few thousand at a time; the packs of a block travel together afterwards
    packs = max(1, -(-BLOCK // PACK))
    pack = F.pmod(F.xxhash64(F.col("fp"), F.col("id"), F.lit(1)), F.lit(packs))
    numbered = dealt.select(F.xxhash64("i", "part", pack).alias("g"), "i", F.col("part").cast("int"), "fp", "id", *([] if similarity is None else ["sketch"]))

    def packed(batches):
        for t in grouped(batches):
            # should two packs have one hash, they are taken apart by their block
            block = t.column(1).to_numpy().astype(np.int64) << 32 | t.column(2).to_numpy()
            for b in np.unique(block):
                rows = t.filter(pa.array(block == b))
                made = [pa.array([int(b >> 32)], pa.int32()), pa.array([int(b & 0xFFFFFFFF)], pa.int32()),
                        *[pa.array([rows.column(k).to_numpy().tobytes()], pa.binary()) for k in (3, 4)],
                        pa.array([b"" if similarity is None else b"".join(rows.column(5).to_pylist())], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["i", "part", "fps", "ids", "sketches"])

    whole = stored(numbered.repartition("g").sortWithinPartitions("g").mapInArrow(
        packed, "i int, part int, fps binary, ids binary, sketches binary"), "packs")
    # a block meets every block whose population counts come within the radius of its own
    meets = F.filter(F.sequence(F.lit(0), F.lit(len(groups) - 1)), lambda o: F.greatest(
        F.element_at(low, o + 1) - F.element_at(high, F.col("i") + 1), F.element_at(low, F.col("i") + 1) - F.element_at(high, o + 1)) <= radius)
    others = F.flatten(F.transform(meets, lambda o: F.transform(
        F.sequence(F.lit(0), F.element_at(parts, o + 1) - 1), lambda s: F.struct(o.alias("i"), s.cast("int").alias("part")))))
    own = F.struct("i", "part")
    met = whole.withColumn("o", F.explode(others)).select(
        F.xxhash64(F.least(own, F.col("o")), F.greatest(own, F.col("o"))).alias("pair"), "i", "part",
        F.col("o.i").alias("oi"), F.col("o.part").alias("op"), "fps", "ids", "sketches")

    def joined(rows: list[dict]) -> Tiles:
        marks = np.frombuffer(b"".join(r["sketches"] for r in rows), np.uint8).reshape(-1, BINS) if similarity is not None else None
        fps, ids = (np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in ("fps", "ids"))
        return Tiles(fps.view(np.uint64), ids, marks)

    def compared(batches):
        for t in grouped(batches):
            rows = t.to_pylist()
            sides: dict[tuple, dict] = {}
            for r in rows:  # should two pairs have one hash, they are taken apart here
                me, other = (r["i"], r["part"]), (r["oi"], r["op"])
                sides.setdefault((min(me, other), max(me, other)), {}).setdefault(me, []).append(r)
            for (one, two), parts_of in sides.items():
                if len(parts_of) < (1 if one == two else 2):
                    continue  # the other block is empty
                a = joined(parts_of[one])
                b = a if one == two else joined(parts_of[two])
                ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
                order = np.argsort(ids)
                place = np.empty_like(order)
                place[order] = np.arange(len(ids))  # the lowest place has the smallest id
                union, shift = Union(len(ids)), 0 if a is b else len(a.ids)
                for x, y in close_pairs(a, b, radius, similarity):
                    union.link(place[x], place[y + shift])
                roots = union.all_roots()
                linked = np.flatnonzero(roots != np.arange(len(roots)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[order[linked]]), pa.array(ids[order[roots[linked]]])], ["a", "b"])

    return met.repartition("pair").sortWithinPartitions("pair").mapInArrow(compared, "a long, b long")


def near_duplicates(prints: DataFrame, *, key: str = "doc_id", radius: int = 12, similarity: float | None = 0.8) -> DataFrame:
    """Rows ``(key, fp, component)`` of the rows of ``fingerprints``: the smallest key reachable over links.

    Fingerprints at most ``radius`` bits apart are linked; with a ``similarity``, only if their sketches agree to that
    share (``similarity=None``: by the radius alone).  Equal fingerprints are one class, named by its smallest key;
    only different fingerprints are compared, all of them.  A null key takes its class's component and names none; a
    class of null keys only has a null component.
    """
    columns = ["fp"] if similarity is None else ["fp", "sketch"]
    prints = stored(prints.select(F.col(key).cast("long").alias("id"), *columns), "fingerprints")
    first = F.min(F.struct("id", *columns[1:])).alias("first")
    classes = stored(prints.where("id is not null").groupBy("fp").agg(first, F.count("*").alias("n")).select("fp", "first.*", "n"), "classes")
    links = class_links(classes, radius, similarity)
    named = classes.join(components(links, "a", "b"), "id", "left").select(
        F.col("fp").alias("f"), F.coalesce("component", "id").alias("component"), "id", "n")
    named = named.where("n > 1 or component <> id").select("f", "component")
    return prints.join(named, prints["fp"] == named["f"], "left").select(
        F.col("id").alias(key), "fp", F.coalesce("component", "id").alias("component"))


def common_counts(sets: list[np.ndarray], split: int) -> np.ndarray:
    """How many numbers each of the first ``split`` sets has in common with each of the others (0: all with all)."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    code = np.cumsum(np.append(True, values[1:] != values[:-1])) - 1 if len(values) else np.zeros(0, np.int64)
    shared = np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool)
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    out = np.zeros((split or len(sets), len(sets) - split))
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, SHINGLES):
        low, high = np.searchsorted(code, [at, at + SHINGLES])
        there = np.zeros((len(sets), SHINGLES), np.float32)
        there[owner[low:high], code[low:high] - at] = 1
        out += there[:split or len(sets)] @ there[split:].T
    return out


def exact_links(ids: np.ndarray, sets: list[np.ndarray], split: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids that join up the sets whose common share is at least ``similarity``: of all pairs, or across the split."""
    sizes, common = np.array([len(x) for x in sets]), common_counts(sets, split)
    whole = sizes[:split or len(sets), None] + sizes[None, split:] - common
    x, y = np.nonzero(common / np.maximum(1, whole) >= similarity)
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(ids))
    union = Union(len(ids))
    union.link(place[x], place[y + split])
    roots = union.all_roots()
    linked = np.flatnonzero(roots != np.arange(len(roots)))
    return ids[order[linked]], ids[order[roots[linked]]]


def confirmed(df: DataFrame, candidates: DataFrame, *, key: str, text: str, words: int, seed: int, similarity: float) -> DataFrame:
    """Rows ``(a, b)`` that join up the documents of a candidate group ``(id, component)`` with enough common shingles.

    All pairs of a group are counted.  Groups larger than ``GROUP`` are cut into parts that meet pair by pair.
    """
    # at most a row per GROUP documents
    large = candidates.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
    placed = candidates.join(F.broadcast(large), "component", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / GROUP).cast("int"), F.lit(1)))
    placed = placed.select("id", "component", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(placed.hint("shuffle_hash"), "id")
    texts = texts.select(F.xxhash64("component", "part").alias("g"), "component", "part", "parts", "id", "text")
    link_fields, pack_fields = "a long, b long", "component long, part int, parts int, ids binary, sizes binary, shingles binary"
    names = ["a", "b", "component", "part", "parts", "ids", "sizes", "shingles"]

    def inside(batches):
        for t in grouped(batches):
            own: dict[tuple, dict] = {}
            for component, part, parts, i, value in zip(*[t.column(k).to_pylist() for k in range(1, 6)], strict=True):
                hashes = np.unique(shingle_hashes(value, words, seed))
                own.setdefault((component, part, parts), {})[i, hashes.tobytes()] = hashes  # a repeated row counts once
            for (component, part, parts), found in own.items():
                ids, sets = np.array([i for i, _ in found], np.int64), list(found.values())
                a, b = exact_links(ids, sets, 0, similarity)
                none = [pa.nulls(len(a), k) for k in (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names)
                if parts > 1:
                    packed = [ids.tobytes(), np.array([len(x) for x in sets], np.int64).tobytes(), np.concatenate(sets).tobytes()]
                    yield pa.RecordBatch.from_arrays([
                        pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([component], pa.int64()), pa.array([part], pa.int32()),
                        pa.array([parts], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], names)

    def across(batches):
        for t in grouped(batches):
            sides: dict[tuple, list] = {}
            for r in t.to_pylist():
                sides.setdefault((r["component"], r["low"], r["high"]), []).append(r)
            for rows in sides.values():
                if len(rows) < 2:
                    continue  # the other part is empty
                ids = [np.frombuffer(r["ids"], np.int64) for r in rows]
                sets = [x for r in rows for x in np.split(np.frombuffer(r["shingles"], np.uint64), np.cumsum(np.frombuffer(r["sizes"], np.int64))[:-1])]
                a, b = exact_links(np.concatenate(ids), sets, len(ids[0]), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    first = stored(texts.repartition("g").sortWithinPartitions("g").mapInArrow(inside, f"{link_fields}, {pack_fields}"), "counted")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part"))
    met = first.where("component is not null").withColumn("o", F.explode(others)).withColumns(
        {"low": F.least("part", "o"), "high": F.greatest("part", "o")})
    met = met.select(F.xxhash64("component", "low", "high").alias("pair"), "component", "low", "high", "ids", "sizes", "shingles")
    second = met.repartition("pair").sortWithinPartitions("pair").mapInArrow(across, link_fields)
    return first.where("a is not null").select("a", "b").union(second)


def similar_documents(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, seed: int = 42,
                      radius: int = 20, similarity: float = 0.8) -> DataFrame:
    """Rows ``(key, component)``: the smallest key reachable over pairs that have a share ``similarity`` of their different
    word shingles in common (Jaccard), counted exactly up to collisions of 64-bit hashes.

    Texts of equal shingles are one class.  Classes whose fingerprints are at most ``radius`` bits apart and whose
    sketches agree to ``similarity`` less ``SLACK`` hang together as candidates, and all pairs of a candidate group
    are counted.  Fingerprints are those of the different shingles, so that 20 bits miss a pair at 0.8 with a
    probability below 0.0008 (0.005 for the worst sizes, 4 and 5 shingles) and a closer pair less often.  Texts
    without words are one class.  A null key takes its class's component and names none; a class of null keys only
    has a null component.
    """
    def make():
        def work(batch):
            prints, marks, contents = [], [], []
            for some in bounded(batch.column(1).to_pylist()):
                for t in some:
                    hashes = np.unique(shingle_hashes(t, words, seed))
                    prints.append(fingerprint(hashes))
                    marks.append(sketch(hashes))
                    contents.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
            numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, contents)]
            return [batch.column(0), numbers[0], (marks, pa.binary()), numbers[1]]
        return work

    rows = df.select(F.col(key).cast("long").alias("id"), text)
    prints = stored(map_rows(rows, "id long, fp long, sketch binary, content long", make), "prints")
    first = F.min(F.struct("id", "fp", "sketch")).alias("first")
    classes = stored(prints.where("id is not null").groupBy("content").agg(first, F.count("*").alias("n")).select("content", "first.*", "n"), "classes")
    candidates = stored(components(class_links(classes, radius, similarity - SLACK), "a", "b"), "candidates")
    links = confirmed(df, candidates, key=key, text=text, words=words, seed=seed, similarity=similarity)
    named = classes.join(components(links, "a", "b"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = named.where("n > 1 or component <> id").select(F.col("content").alias("c"), "component")
    return prints.join(named, prints["content"] == named["c"], "left").select(
        F.col("id").alias(key), F.coalesce("component", "id").alias("component"))
