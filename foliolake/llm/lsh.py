"""Near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted and cut into intervals of one width; several such
numbers name a bucket, in each of several tables.  Vectors that share a bucket are compared exactly by cosine in
double precision.  A bucket larger than a tile is cut into tiles that meet pairwise, so one task never holds more
than two tiles.  A pair is counted in the first table that brings it together, so no pair is ever emitted: a task
gives, per vector, the number of its new links and the smallest vector it hangs together with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .groups import Union, components, grouped

#: Tables, projections of a bucket, and width of their intervals.  A pair of cosine 0.93 is 0.374 apart and shares an
#: interval with probability 0.80, so it is missed by all tables with (1 - 0.80 ** 6) ** 24, below one in a thousand;
#: pairs of cosine 0.95 with one in ten thousand.
TABLES, PROJECTIONS, WIDTH = 24, 6, 1.5
#: Vectors of a tile.
TILE = 1024
SEED = 20_240_229


def _units(flat: np.ndarray, dims: int) -> np.ndarray:
    v = flat.reshape(-1, dims)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def bucket_numbers(units: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One 32-bit number per vector and table: a hash of its intervals."""
    draw = np.random.default_rng(seed)
    directions = draw.standard_normal((units.shape[1], tables * projections))
    shifts = draw.uniform(0, width, tables * projections)
    cells = np.floor((units @ directions + shifts) / width).astype(np.int64).reshape(len(units), tables, projections)
    mixed = np.zeros(cells.shape[:2], np.uint64)
    for k in range(projections):
        mixed = (mixed ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def usable(vector: str, label: str) -> Column:
    """Label and vector not null, no null or non-finite component, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
                 tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """Rows ``(key, n_links, component_id, kept)``, one per input row.

    Vectors of equal labels whose cosine is ``threshold`` or more are linked.  Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null label or key, link with nothing: 0 links, a component
    of their own, kept.  Vectors of different lengths never link.  Equal vectors of a label are one class that is
    hashed once; a repeated row counts as a vector of its own.  Other columns are left out.
    """
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                     F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("ok", F.col("id").isNotNull() & usable("v", "label"))
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))

    def hashed(batches):
        for batch in batches:
            labels, vectors, reps, n = batch.columns
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, begins = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1]
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                own = flat[(begins[at][:, None] + np.arange(dims)).ravel()]
                units = _units(own, dims)
                numbers = bucket_numbers(units, tables, projections, width, SEED)
                raw = own.reshape(-1, dims)
                small = (raw.astype(np.float32) == raw).all(axis=1)
                packed = [(r.astype(np.float32) if s else r).tobytes() for r, s in zip(raw, small.tolist(), strict=True)]
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [labels.take(pick), reps.take(pick), n.take(pick), pa.array(np.full(len(at), dims, np.int32)), pa.array(packed, pa.binary()),
                     pa.array(numbers.tolist(), pa.list_(pa.int32()))], ["label", "rep", "n", "dims", "raw", "numbers"])

    schema = "label string, rep long, n long, dims int, raw binary, numbers array<int>"
    known = stored(classes.select("label", "v", "rep", "n").mapInArrow(hashed, schema), "vectors")
    placed = known.select("rep", "n", "label", "dims", "raw", "numbers", F.posexplode("numbers").alias("t", "number"))
    placed = placed.withColumn("bucket", F.xxhash64("label", "dims", "t", "number"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size"))
    large = stored(sizes.where(F.col("size") > TILE).select("bucket", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "large")
    # the join leaves small buckets as they are; a tile of a large one meets every tile of its bucket
    dealt = placed.join(large, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    meets = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("side", "o"), F.greatest("side", "o")
    meets = meets.select(F.xxhash64("bucket", low, high).alias("g"), low.alias("low"), high.alias("high"), "side", "t", "number",
                         "label", "dims", "rep", "n", "raw", "numbers")

    def linked(batches):
        for t in grouped(batches):
            if t.num_rows < 2:
                continue
            low_, high_, side, table_, number = (t.column(k).to_numpy() for k in range(1, 6))
            dims = t.column(7).to_numpy()
            label_ = np.unique(t.column(6).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
            # buckets that share the group's hash by chance are told apart
            real = np.unique(np.stack([low_, high_, table_, number, dims, label_], axis=1), axis=0, return_inverse=True)[1].ravel()
            for one in range(real.max() + 1):
                at = np.flatnonzero(real == one)
                if len(at) > 1:
                    part = t.take(pa.array(at)) if real.max() else t
                    batch = _tile_links(part, side[at], int(low_[at[0]]), int(high_[at[0]]), int(table_[at[0]]), int(dims[at[0]]), threshold)
                    if batch is not None:
                        yield batch

    found = stored(meets.repartition("g").sortWithinPartitions("g").mapInArrow(linked, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select("rep", "root"), "rep", "root")
    own = classes.join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.coalesce("component", "rep").alias("component"))
    own = stored(own.where("links > 0"), "linked")
    out = rows.join(own, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").cast(kind).alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _tile_links(t: pa.Table, side: np.ndarray, low: int, high: int, table: int, dims: int, threshold: float) -> pa.RecordBatch | None:
    """New links of one tile, or between two tiles of a bucket."""
    rep, n = t.column(8).to_numpy(), t.column(9).to_numpy()
    raw = t.column(10).to_pylist()
    flat = np.concatenate([np.frombuffer(r, np.float32 if len(r) == 4 * dims else np.float64).astype(np.float64) for r in raw])
    order = np.argsort(rep)
    units, rep, n, side = _units(flat, dims)[order], rep[order], n[order], side[order]
    rows = np.flatnonzero(side == low)
    columns = rows if low == high else np.flatnonzero(side == high)
    if not len(rows) or not len(columns):
        return None
    i, j = np.nonzero(units[rows] @ units[columns].T >= threshold)
    i, j = rows[i], columns[j]
    if low == high:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return None
    numbers = np.array(t.column(11).to_pylist(), np.int32)[order]
    new = np.ones(len(i), bool)
    for before in range(table):
        new &= numbers[i, before] != numbers[j, before]
    i, j = i[new], j[new]
    if not len(i):
        return None
    links = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
    union = Union(len(rep))
    union.link(i, j)
    roots = union.all_roots()
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(links[at].astype(np.int64)), pa.array(rep[roots[at]])], ["rep", "links", "root"])
