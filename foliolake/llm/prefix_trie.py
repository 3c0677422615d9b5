"""Prefix trie of conversations, built as a burst trie.

A turn is known by a digest of its role and text, so texts are not moved.  Equal conversations become one sequence
with a number of members.  All sequences begin in one container; a container of more than ``CONTAINER`` sequences
bursts: its prefix becomes a trie head, and its sequences go to new containers by their next turn.  Counting the
sequences below the prefixes of a few depths at once says which prefixes burst, deeper and deeper (twice as many depths
each round) where there are still too many.  The containers that remain are dealt out, sorted, and swept into nodes
with one open path in memory; heads get their sums from the containers below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

#: Sequences that a container may hold before it bursts, and depths of the first round of bursting.
CONTAINER, DEPTHS = 256, 4
#: Bytes of a turn's digest and of a prefix's.
WIDE = 16
#: Ids joined into one text before it moves: a group of copies is hashed from such texts, in order.
CHUNK_IDS = 65_536
#: Ways that the rows below one head are dealt for the join with it.
SALTS = 16

NOTHING = hashlib.sha256(b"").hexdigest()
SEQUENCE = "digest binary, path binary, sizes binary, conv_id long"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_lists(df: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turns array<struct<turn, id, chars>>)``: the turns of each conversation in order.

    Ordered by turn, null first; equal turns by the digest of role and text (so that repeated rows follow each other).
    A null role or text is empty.  Rows without a conv_id belong to no conversation and are left out.  A conversation is
    one row of some 30 bytes a turn, however long its texts are.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.substring(digest, 1, WIDE).alias("id"), F.length(text).alias("chars")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def led(lists: DataFrame, *, family: int = 100, most: int = 6) -> DataFrame:
    """The conversations with the first ``h`` turns of the first conversation of their family in front.

    The family of ``c`` begins at ``c - c % family`` (floored); ``h`` is crc32 of the decimal id modulo ``most``.  The first
    ``h`` turns of that conversation, all if it has fewer and none if it is not there, then the own turns after the first ``h``.
    """
    first = F.pmod(F.col("conv_id"), F.lit(family)) == 0
    leads = lists.where(first).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, most - 1).alias("_lead"))
    own = lists.withColumns({"_first": F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(family)),
                             "_h": F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")})
    h, rest = F.col("_h"), F.greatest(F.size("turns") - F.col("_h"), F.lit(0))
    lead = F.when(F.col("_lead").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_lead", F.lit(1), h))
    return own.join(leads, "_first", "left").select("conv_id", F.concat(lead, F.slice("turns", h + 1, rest)).alias("turns"))


def prefixes(path: bytes, first: int, last: int) -> list[bytes]:
    """Digests of the prefixes of ``path`` of ``first`` to ``last`` turns, as far as it goes."""
    h = hashlib.blake2b(path[:first * WIDE], digest_size=WIDE)
    out = []
    for at in range(first * WIDE, min(last * WIDE, len(path)) + 1, WIDE):
        out.append(h.copy().digest())
        h.update(path[at:at + WIDE])
    return out


def sequences(lists: DataFrame) -> DataFrame:
    """Rows ``(digest, path, sizes, conv_id)``: turn digests and code points of each conversation, packed."""
    def make():
        def work(batch):
            turns = batch.column(1)
            ids, chars = turns.flatten().field("id").to_pylist(), turns.flatten().field("chars").to_pylist()
            sizes, packed = [n or 0 for n in pa.compute.list_value_length(turns).to_pylist()], [[], [], []]
            at = 0
            for n in sizes:
                path = b"".join(ids[at:at + n])
                packed[0].append(hashlib.blake2b(path, digest_size=WIDE).digest())
                packed[1].append(path)
                packed[2].append(np.array(chars[at:at + n], "<i4").tobytes())
                at += n
            return [*((p, pa.binary()) for p in packed), batch.column(0)]
        return work

    return map_rows(lists.select("conv_id", "turns"), SEQUENCE, make)


def id_digests(members: DataFrame) -> DataFrame:
    """Rows ``(digest, sha)``: SHA-256 of the decimal conv_ids of each sequence, ascending and joined by commas.

    The ids are sorted over all partitions, so that a large group of copies spans many of them, and joined into texts
    there; only those texts, in order and one at a time, come together to be hashed.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, ids, out = None, [], []

        def told():
            made = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["digest", "first", "ids"])
            out.clear()
            return made

        for batch in batches:
            for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if d != digest or len(ids) == CHUNK_IDS:
                    if ids:
                        out.append((digest, ids[0], ",".join(map(str, ids))))
                        if len(out) > 4096 or len(ids) > 4096:
                            yield told()
                    digest, ids = d, []
                ids.append(c)
        if ids:
            out.append((digest, ids[0], ",".join(map(str, ids))))
        yield told()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, h, done = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.column(0)[i].as_py()
                if d != digest:
                    done += [] if digest is None else [(digest, h.hexdigest())]
                    digest, h = d, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(batch.column(2)[i].as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.binary()), pa.array([r[1] for r in done], pa.string())],
                                             ["digest", "sha"])
            done = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([h.hexdigest()])], ["digest", "sha"])

    types = [pa.binary(), pa.int64(), pa.string()]
    parts = members.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    parts = parts.mapInArrow(joined, "digest binary, first long, ids string")
    return parts.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, "digest binary, sha string")


def keys(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows ``(digest, depth, key, parent, chars, n, conv_id)``: the prefixes of ``first`` to ``last`` turns of each sequence."""
    names = ["digest", "depth", "key", "parent", "chars", "n", "conv_id"]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                out = []
                for digest, path, sizes, n, conv in zip(*(c.to_pylist() for c in whole.slice(start, 512).columns), strict=True):
                    begin = max(first - 1, 0)
                    line, chars = prefixes(path, begin, last), np.frombuffer(sizes, "<i4")
                    for depth in range(first, begin + len(line)):
                        up = line[depth - 1 - begin] if depth else None
                        out.append((digest, depth, line[depth - begin], up, int(chars[depth - 1]) if depth else 0, n, conv))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    schema = "digest binary, depth long, key binary, parent binary, chars long, n long, conv_id long"
    return rows.select("digest", "path", "sizes", "n", "conv_id").mapInArrow(run, schema)


def burst(rows: DataFrame, container: int) -> tuple[DataFrame, DataFrame]:
    """Heads ``(key, parent, depth, chars, n_convs, conv_id)``, and ``(digest, top)``: the depth of each sequence's deepest head.

    The root is always a head.  A prefix bursts when more than ``container`` different sequences begin with it.
    """
    first, last, alive = 0, DEPTHS, rows
    all_heads, placed = [], []
    while True:
        level = keys(alive, first, last)
        heads = level.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
                                         F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count("*").alias("held"))
        heads = stored(heads.where((F.col("held") > container) | (F.col("depth") == 0)).drop("held"), "heads")
        all_heads.append(heads)
        placed.append(level.join(heads.select("key"), "key", "left_semi").groupBy("digest").agg(F.max("depth").alias("top")))
        deep = heads.where(F.col("depth") == last).select("key")
        if deep.isEmpty():
            break
        below = keys(alive, last, last).join(deep, "key", "left_semi").select("digest")
        alive = stored(alive.join(below, "digest", "left_semi"), "alive")
        first, last = last + 1, 2 * last
    heads, tops = all_heads[0], placed[0]
    for more_heads, more_tops in zip(all_heads[1:], placed[1:], strict=True):
        heads, tops = heads.unionByName(more_heads), tops.unionByName(more_tops)
    return heads, tops.groupBy("digest").agg(F.max("top").alias("top"))


class Sweep:
    """Nodes of one container from its sequences in order; only the open path and the closed children on it are held."""

    def __init__(self):
        self.open: list[list] = []  # [depth, conv_id, n_convs, n_children, n_leaves, saved, sha, chars, closed children]
        self.path, self.out = b"", []

    def add(self, top: int, path: bytes, chars: np.ndarray, n: int, conv: int, sha: str) -> None:
        """A sequence whose part below depth ``top`` is ``path``; not before the one added last."""
        same = 0
        for same in range(min(len(self.open), len(path) // WIDE) + 1):
            if same == len(self.open) or self.path[same * WIDE:(same + 1) * WIDE] != path[same * WIDE:(same + 1) * WIDE]:
                break
        self.close(same)
        for at in range(same, len(path) // WIDE):
            self.open.append([top + at + 1, conv, 0, 0, 0, 0, NOTHING, int(chars[at]), []])
        self.path = path
        last = self.open[-1]
        last[6], last[1], last[2] = sha, min(last[1], conv), last[2] + n

    def close(self, left: int) -> None:
        """Closes the open nodes but for ``left`` of them; the top node stays for the caller where none is left."""
        while len(self.open) > left:
            node = self.open.pop()
            node[4] = node[4] or 1
            node[5] += (node[2] - 1) * node[7]
            self.out += [(*row[:2], node[1], *row[3:]) for row in node[8]]
            row = (node[1], node[0], None, *node[2:7])
            if self.open:
                up = self.open[-1]
                up[1], up[2], up[3], up[4], up[5] = min(up[1], node[1]), up[2] + node[2], up[3] + 1, up[4] + node[4], up[5] + node[5]
                up[8].append(row)
            else:
                self.out.append(row)


def swept(rows: DataFrame) -> DataFrame:
    """Nodes below the heads, and one row per sequence that ends in a head.

    ``NODE`` and ``line``: for top nodes of containers and for ended sequences the digests of the heads above (the last
    one is the node itself for an ended sequence, which has depth null), else null.
    """
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["container", "top", "line", "path", "sizes", "n", "conv_id", "sha"]
        types = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                out = []
                for path, sizes, n, conv, sha, top in zip(*(c.to_pylist() for c in whole.slice(start, 512).columns), strict=True):
                    line = prefixes(path, 0, top + 1)
                    # an ended sequence is a container of its own
                    container = line[top + 1] if len(line) > top + 1 else b"end" + line[top]
                    out.append((container, top, b"".join(line[:top + 1]), path[top * WIDE:], sizes[top * 4:], n, conv, sha))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in NODE.split(", ")]
        types = [pa.int64() if kind == "long" else pa.string() for _, kind in fields] + [pa.binary()]
        names = [name for name, _ in fields] + ["line"]
        now, line, work, out = None, None, Sweep(), []

        def closed():
            work.close(0)
            if work.out:  # the container's top node is the last
                out.extend((*row, None) for row in work.out[:-1])
                out.append((*work.out[-1], line))
                work.out.clear()

        def told():
            made = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)
            out.clear()
            return made

        for batch in batches:
            for container, top, above, path, sizes, n, conv, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if container != now:
                    closed()
                    now, line = container, above
                if path:
                    work.add(top, path, np.frombuffer(sizes, "<i4"), n, conv, sha)
                else:
                    out.append((conv, None, None, n, 0, 0, 0, sha, above))
                if len(work.out) > 8192:
                    out.extend((*row, None) for row in work.out)
                    work.out.clear()
                if len(out) > 8192:
                    yield told()
        closed()
        yield told()

    parts = rows.select("path", "sizes", "n", "conv_id", "sha", "top").mapInArrow(
        dealt, "container binary, top long, line binary, path binary, sizes binary, n long, conv_id long, sha string")
    return parts.repartition("container").sortWithinPartitions("container", "path").mapInArrow(sweep, f"{NODE}, line binary")


def lines(tops: DataFrame) -> DataFrame:
    """Rows ``(key, depth, last, conv_id, n_leaves, saved, sha)``: every head above a top node or ended sequence."""
    names = ["key", "depth", "child", "conv_id", "n_leaves", "saved", "sha"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                out = []
                for line, ended, conv, leaves, saved, sha in zip(*(c.to_pylist() for c in whole.slice(start, 512).columns), strict=True):
                    deepest = len(line) // WIDE - 1
                    for depth in range(deepest + 1):
                        at = depth == deepest
                        out.append((line[depth * WIDE:(depth + 1) * WIDE], depth, int(at and not ended), conv, leaves, saved, sha if at and ended else None))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    rows = tops.select("line", F.isnull("depth").alias("ended"), "conv_id", "n_leaves", "saved_tokens", "ends_sha256")
    return rows.mapInArrow(run, "key binary, depth long, child long, conv_id long, n_leaves long, saved long, sha string")


def head_nodes(heads: DataFrame, tops: DataFrame) -> DataFrame:
    """The heads as nodes, with the sums over the containers below them.

    What a head saves itself counts for all heads above it too: the top node (or ended sequence) that holds the head's
    smallest conversation carries it up its line.
    """
    own = heads.select("key", "conv_id", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    below = lines(tops).join(own, ["key", "conv_id"], "left")
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = below.withColumn("carried", F.sum(F.coalesce("own", F.lit(0))).over(up))
    sums = below.groupBy("key").agg(F.sum("child").alias("containers"), F.sum("n_leaves").alias("leaves"),
                                    F.sum(F.col("saved") + F.col("carried")).alias("saved_tokens"), F.max("sha").alias("sha"))
    children = heads.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("head_children"))
    n_children = F.col("containers") + F.coalesce("head_children", F.lit(0))
    nodes = heads.join(sums, "key").join(children, "key", "left").select(
        "conv_id", "depth", "n_convs", n_children.alias("n_children"), F.greatest("leaves", F.lit(1)).alias("n_leaves"),
        "saved_tokens", F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"), "parent")
    return with_parent(nodes, heads)


def with_parent(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """``parent_conv_id`` by the digest ``parent``, over salted keys: one head may be above most nodes."""
    salted = heads.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = nodes.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    return salt.join(salted, ["parent", "_salt"], "left").select(*[f.split()[0] for f in NODE.split(", ")])


def trie(lists: DataFrame, *, container: int = CONTAINER) -> DataFrame:
    """One row per different prefix of the turn lists, the empty one (root) included: see ``NODE``.

    ``lists`` has one row ``(conv_id, turns)`` per conversation, see ``turn_lists``.  Members of a node are the conversations
    that begin with its prefix; ``conv_id`` is the smallest, ``parent_conv_id`` the parent's.  ``n_leaves`` and ``saved_tokens``
    (members but one, times the code points of the last text) are summed over the subtree, the node included;
    ``ends_sha256`` is of the ids of the members that end there.  Without conversations there are no nodes.
    ``container`` changes how the work is dealt, not the result.
    """
    members = stored(sequences(lists), "members")
    rows = members.groupBy("digest").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"),
                                         F.min("conv_id").alias("conv_id"))
    rows = stored(rows.join(id_digests(members.select("digest", "conv_id")), "digest"), "sequences")
    heads, tops = burst(rows, container)
    nodes = stored(swept(rows.join(tops, "digest")), "nodes")
    marked = nodes.where("line is not null")
    inner = nodes.where("line is null").drop("line")
    last = F.substring(F.col("line"), -WIDE, WIDE)
    upper = with_parent(marked.where("depth is not null").withColumn("parent", last).drop("line", "parent_conv_id"), heads)
    return inner.unionByName(upper).unionByName(head_nodes(heads, marked))


def conversation_trie(df: DataFrame, *, container: int = CONTAINER) -> DataFrame:
    """The trie of the conversations of ``(conv_id, turn, role, text)`` as families that share their first turns, see ``led``."""
    return trie(led(turn_lists(df)), container=container)
