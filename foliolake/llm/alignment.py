"""Alignment of the tokens of two tokenizers over the same bytes, by pointer jumping.

Every token points to the token that reaches farthest right among those it overlaps (the other tokenizer's on equal
ends), so that pointers only lead right.  Doubling all pointers of a batch at once, until none changes, brings every
token to the last token of its component: the group between two byte offsets where tokens of both sides end.

Tokens of one group are linked, each with each of the other side.  How many documents hold a pair of ids linked is
counted in two steps: inside each task first, then by pair.  The counts come back to the documents in two tiers: the
most frequent pairs as a broadcast table of bounded size, all others by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, sentence_pieces
from .common import stored
from .token_counts import byte_letters

#: Pairs of ids whose counts are broadcast: at most so many, 13 bytes each.  Changes the speed only.
FREQUENT = 400_000
#: Characters of text, links and pairs worked on together; pieces each of the two codecs remembers.
RUN, BLOCK, CACHE = 1_000_000, 4_000_000, 150_000


class ByteCodec(bpe.Codec):
    """The codec of ``bpe`` for a tokenizer file whose merges have the ids of their results in order."""

    def __init__(self, path: str, pattern: str):
        with open(path) as f:
            rules = json.load(f)
        model, vocab = rules["model"], rules["model"]["vocab"]
        first = vocab["".join(model["merges"][0])]
        if rules["normalizer"] or rules["pre_tokenizer"]["type"] != "ByteLevel" or not rules["pre_tokenizer"]["use_regex"]:
            raise ValueError(f"{path}: only byte-level tokenizers that leave the text as it is")
        if any(vocab[a + b] != first + n for n, (a, b) in enumerate(model["merges"])):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        special = {t["content"] for t in rules["added_tokens"]}
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        self.ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split, self.quick = regex.compile(pattern), bpe.latin_split(pattern)
        self.latin = re.compile("[\x00-ɏ]*")
        self.pieces = bpe.Pieces(self.ranks, CACHE)


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0, of the tokens of two sides that end at these ascending byte offsets and cover the same bytes."""
    if not len(ends_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = len(ends_a), len(ends_b)
    starts_a, starts_b = (np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b))
    succ = np.empty(a + b, np.int64)
    succ[:a] = a + np.searchsorted(starts_b, ends_a) - 1
    over = np.searchsorted(starts_a, ends_b) - 1
    succ[a:] = np.where(ends_a[over] > ends_b, over, np.arange(a, a + b))
    while True:
        twice = succ[succ]
        if np.array_equal(twice, succ):
            break
        succ = twice
    number = np.cumsum(succ[a:] == np.arange(a, a + b)) - 1
    return number[succ[:a] - a], number[succ[a:] - a]


def distinct(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often (or with what sum of ``times``) each is there."""
    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


class Aligner:
    def __init__(self, path_a: str, pattern_a: str, path_b: str):
        self.a, self.b = ByteCodec(path_a, pattern_a), sentence_pieces.PieceCodec(path_b, CACHE)
        if len(self.a.tokens) > 1 << 16 or len(self.b.vocabulary.pieces) > 1 << 16:
            raise ValueError("ids of both tokenizers must fit 16 bits")
        self.size_a = np.array([len(t) for t in self.a.tokens], np.int64)
        self.size_b = np.array([len(t) for t in self.b.vocabulary.raw], np.int64)
        self.written = [f"{i}{sep}" for sep in ",|;" for i in range(1 << 16)]

    def tokens(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of both sides; none where the text is empty or a side does not read blank + text.

        Both codecs give back every byte, but the second one reads its blank letter as a blank.
        """
        some = [None if not t or sentence_pieces.BLANK in t else t for t in texts]
        packed_a = self.a.encode([None if t is None else " " + t for t in some])
        packed_b = [self.b.encode(t) for t in some]
        for i, t in enumerate(some):
            if t is not None and not self.reads(t, packed_a[i], packed_b[i]):
                packed_a[i] = packed_b[i] = b""
        return packed_a, packed_b

    def reads(self, text: str, a: bytes, b: bytes) -> bool:
        size = 1 + len(text.encode())
        return int(self.size_a[ids_of(a)].sum()) == size == int(self.size_b[ids_of(b)].sum())

    def groups(self, packed_a: list[bytes], packed_b: list[bytes]) -> dict[str, np.ndarray]:
        """Ids, documents and group numbers of all tokens of a run of documents (whose ends are ends of groups)."""
        a, b = ids_of(b"".join(packed_a)), ids_of(b"".join(packed_b))
        group_a, group_b = components(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        n_a, n_b = (np.array([len(p) // 4 for p in packed], np.int64) for packed in (packed_a, packed_b))
        return {"a": a, "b": b, "group_a": group_a, "group_b": group_b, "n_a": n_a, "n_b": n_b,
                "in_a": np.bincount(group_a), "in_b": np.bincount(group_b),
                "doc_a": np.repeat(np.arange(len(n_a)), n_a)}

    def shas(self, g: dict[str, np.ndarray]) -> list[str]:
        """Digest of ``a1,a2|b1;a3|b2,b3`` of each document; empty without tokens."""
        behind_a = np.cumsum(g["in_b"]) - g["in_b"]
        behind_b = np.cumsum(g["in_a"])
        code = np.empty(len(g["a"]) + len(g["b"]), np.int64)
        for ids, group, behind, last in ((g["a"], g["group_a"], behind_a, 1), (g["b"], g["group_b"], behind_b, 2)):
            closes = np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, bool)
            code[np.arange(len(ids)) + behind[group]] = ids + np.where(closes, last << 16, 0)
        out, at, written = [], 0, self.written.__getitem__
        for n in (g["n_a"] + g["n_b"]).tolist():
            text = "".join(map(written, code[at:at + n].tolist()))
            at += n
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if n else "")
        return out

    @staticmethod
    def pairs(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``document << 32 | a << 16 | b`` of all links, each once, and how often it is there."""
        to = g["in_b"][g["group_a"]]  # links of each token of the first side
        first_b = (np.cumsum(g["in_b"]) - g["in_b"])[g["group_a"]]
        front = g["doc_a"].astype(np.uint64) << np.uint64(32) | g["a"].astype(np.uint64) << np.uint64(16)
        b = g["b"].astype(np.uint64)
        stops = np.cumsum(to)
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = 0
        while at < len(to):  # tokens of about BLOCK links, one at least
            till = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + BLOCK, "right")))
            n = to[at:till]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            new, often = distinct(np.repeat(front[at:till], n) | b[np.repeat(first_b[at:till], n) + step])
            keys, times = distinct(np.concatenate([keys, new]), np.concatenate([times, often])) if len(keys) else (new, often)
            at = till
        return keys, times

    def linked(self, texts: list[str | None]) -> list[list]:
        """Per text: n_a, n_b, n_groups, n_links, groups_sha256, its pairs packed and how often each is linked."""
        packed_a, packed_b = self.tokens(texts)
        g = self.groups(packed_a, packed_b)
        docs = len(texts)
        first = np.concatenate([[0], np.cumsum(g["in_a"])[:-1]]).astype(np.int64) if len(g["in_a"]) else np.zeros(0, np.int64)
        doc_of_group = g["doc_a"][first]
        links = np.zeros(docs, np.int64)
        np.add.at(links, doc_of_group, g["in_a"] * g["in_b"])
        keys, times = self.pairs(g)
        cuts = np.searchsorted(keys, np.arange(docs + 1).astype(np.uint64) << np.uint64(32)).tolist()
        low, often = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), times.astype("<u4")
        return [g["n_a"].tolist(), g["n_b"].tolist(), np.bincount(doc_of_group, minlength=docs).tolist(), links.tolist(), self.shas(g),
                [low[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)],
                [often[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]]


def ids_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").astype(np.int64)


@cache
def aligner(path_a: str, pattern_a: str, path_b: str) -> Aligner:
    """One per worker process."""
    return Aligner(path_a, pattern_a, path_b)


def align(df: DataFrame, *, key: str = "doc_id", text: str = "text", path_a: str, pattern_a: str, path_b: str) -> DataFrame:
    """Rows ``(key, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>)``: the tokens of each text
    by both tokenizers and the number of the group, from 0, that each belongs to.

    Null and empty texts, and texts that a tokenizer does not give back whole, have empty lists.  One row per input row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, pattern_a, path_b)
        for keys, texts in runs(batches):
            g = both.groups(*both.tokens(texts))
            kept = []
            for side in "ab":
                cuts = np.concatenate([[0], np.cumsum(g[f"n_{side}"])]).tolist()
                ids, group = g[side], g[f"group_{side}"]
                kept.append([ids[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)])
                kept.append([(group[i:j] - group[i]).tolist() if j > i else [] for i, j in zip(cuts, cuts[1:], strict=False)])
            lists = [pa.array(kept[i], pa.list_(pa.int32())) for i in (0, 2, 1, 3)]
            yield pa.RecordBatch.from_arrays([keys, *lists], names)

    names = [key, "a_ids", "b_ids", "a_groups", "b_groups"]
    kind = df.schema[key].dataType.simpleString()
    lists = ", ".join(f"{n} array<int>" for n in names[1:])
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {lists}")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """The first column and the texts of the second, about ``RUN`` characters at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part, done = batch.slice(at, 1024), 0
            for some in bpe.bounded(part.column(1).to_pylist(), RUN):
                yield part.column(0).slice(done, len(some)), some
                done += len(some)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def links_of(df: DataFrame, key: str, text: str, path_a: str, pattern_a: str, path_b: str) -> DataFrame:
    """Rows ``(_row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``: what a document alone says."""
    kind = df.schema[key].dataType.simpleString()
    names = ["_row", key, *COUNTS, "groups_sha256", "pairs", "times"]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, pattern_a, path_b)
        for keys, texts in runs(batches):
            made = [pa.array(v, t) for v, t in zip(both.linked(texts), types, strict=True)]
            yield pa.RecordBatch.from_arrays([keys.field(0), keys.field(1), *made], names)

    rows = df.select(F.struct(F.monotonically_increasing_id().alias("r"), F.col(key).alias("k")).alias("key"), F.col(text).alias("text"))
    longs = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(run, f"_row long, `{key}` {kind}, {longs}, groups_sha256 string, pairs binary, times binary")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by pair, summed inside the task as far as ``BLOCK`` pairs allow."""
    keys, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def told():
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    def reduced():
        new, often = distinct(np.concatenate(held))
        return distinct(np.concatenate([keys, new]), np.concatenate([n, often])) if len(keys) else (new, often)

    for batch in batches:
        held.append(ids_of(b"".join(batch.column(0).to_pylist())))
        size += len(held[-1])
        if size > BLOCK:
            keys, n = reduced()
            held, size = [], 0
            if len(keys) > BLOCK // 2:
                yield told()
                keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if held:
        keys, n = reduced()
    yield told()


def link_counts(df: DataFrame, *, key: str = "doc_id", text: str = "text", path_a: str, pattern_a: str, path_b: str,
                frequent: int = FREQUENT) -> DataFrame:
    """Rows ``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    A pair of ids counts the documents (rows of ``df``) that hold it linked.  ``count_sum`` adds the counts of a document's
    links, ``n_best`` are its links whose count is the highest of their first id, ties included.  Null and empty texts, and
    texts that a tokenizer does not give back whole: zeros and an empty digest.  One row per input row, repeated and null
    keys included.  ``frequent`` bounds the broadcast table and changes the speed only.
    """
    spark = df.sparkSession
    rows = stored(links_of(df, key, text, path_a, pattern_a, path_b), "links")
    pairs = rows.select("pairs").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.withColumn("a", F.shiftright("pair", 16)), "pairs")
    # one row per id of the first vocabulary, 65,536 at most
    best = pairs.groupBy("a").agg(F.max("n").alias("best"))
    pairs = pairs.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"),
                                                      F.floor(F.log2("n") * 16).alias("step"))
    # the lowest step of the count such that all pairs from it on fit the table; a step is a sixteenth of a doubling
    least, room = 1 << 20, frequent
    for r in sorted(pairs.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = pairs.where(F.col("step") >= least).select("pair", "n", "is_best").toArrow().sort_by("pair")
    held = spark.sparkContext.broadcast((top["pair"].to_numpy().astype("<u4"), top["n"].to_numpy(), top["is_best"].to_numpy()))

    kind = df.schema[key].dataType.simpleString()
    texts = [*COUNTS, "groups_sha256"]

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, is_best = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                packed = batch.column("pairs").to_pylist()
                pair = np.frombuffer(b"".join(packed), "<u4")
                times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
                doc = np.repeat(np.arange(batch.num_rows), [len(p) // 4 for p in packed])
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                there = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                total, top_links = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                np.add.at(total, doc[there], times[there] * n[at[there]])
                np.add.at(top_links, doc[there], times[there] * is_best[at[there]])
                row = batch.column("_row").to_numpy()
                # one row per document, whose negative number meets no pair, and one per pair outside the table
                rare = np.flatnonzero(~there)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), pa.array(-1 - row), pa.array(np.zeros(len(row), np.int64)), pa.array(top_links), pa.array(total),
                     batch.column(key), *[batch.column(c) for c in texts]], names)
                for i in range(0, len(rare), 100_000):
                    some = rare[i:i + 100_000]
                    nulls = [pa.nulls(len(some), f.type) for f in (batch.schema.field(c) for c in (key, *texts))]
                    zeros = pa.array(np.zeros(len(some), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(row[doc[some]]), pa.array(pair[some].astype(np.int64)), pa.array(times[some]),
                                                      zeros, zeros, *nulls], names)

    names = ["_row", "pair", "times", "n_best", "count_sum", key, *texts]
    longs = ", ".join(f"{c} long" for c in COUNTS)
    parts = rows.mapInArrow(resolved, f"_row long, pair long, times long, n_best long, count_sum long, `{key}` {kind}, {longs}, groups_sha256 string")
    rest = pairs.where(F.col("step") < least).select("pair", "n", "is_best")
    joined = parts.join(rest, "pair", "left")
    return joined.groupBy("_row").agg(
        F.max(key).alias(key), *[F.max(c).alias(c) for c in COUNTS],
        F.sum(F.col("n_best") + F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"),
        F.max("groups_sha256").alias("groups_sha256")).drop("_row")
