"""Embedding jobs and vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import embeddable_text, is_embeddable
from .chunking import chunk

#: Query vectors that travel to every task as one matrix; more of them are cut into blocks of about ``TILE_QUERIES``.
QUERY_SLICE, TILE_QUERIES = 4096, 8192
#: Scores that a task works out at once.
_CELLS = 1 << 21


def hashing_encoder(dims: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Deterministic stand-in for a sentence encoder: hashed word counts, unit length."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import re
        import zlib

        word = re.compile(r"[^\W_]+")

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float32)
            for i, text in enumerate(texts):
                h = np.array([zlib.crc32(w.encode()) for w in word.findall((text or "").lower())], dtype=np.int64)
                out[i] = np.bincount(h % dims, weights=(h >> 16 & 1) * 2 - 1, minlength=dims)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms == 0, 1, norms)

        return encode

    return load


def encode(df: DataFrame, text: str, encoder: Callable, *, dims: int | None = None, output: str = "embedding") -> DataFrame:
    """Adds a vector per row; the encoder is made once per task and sees Arrow batches.

    ``dims`` keeps the first components without normalising again.
    """
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for frame in frames:
            vectors = model(frame[text].fillna("").tolist())
            out = frame[keep].copy()
            out[output] = list(vectors[:, :dims] if dims else vectors)
            yield out

    return df.mapInPandas(run, schema)


def pages_to_embed(pages: DataFrame, embedded: DataFrame | None, *, key: Sequence[str], text: str = "text_content",
                   overwrite: bool = False) -> DataFrame:
    """Pages of more than 20 characters that have no vector yet (all of them with ``overwrite``)."""
    worth = pages.filter(F.length(text) > 20)
    return worth if overwrite or embedded is None else worth.join(embedded.select(*key), list(key), "left_anti")


def embed_pages(pages: DataFrame, encoder: Callable, embedded: DataFrame | None = None, *, key: Sequence[str] = ("doc_id", "page_number"),
                text: str = "text_content", model: str = "hashing", overwrite: bool = False) -> DataFrame:
    todo = pages_to_embed(pages, embedded, key=key, text=text, overwrite=overwrite).select(*key, text)
    return encode(todo, text, encoder).select(*key, F.lit(model).alias("model"), F.size("embedding").alias("dims"), "embedding")


def embed_chunks(docs: DataFrame, encoder: Callable, *, doc_id: str = "doc_id", body: str = "text", summary: str | None = None,
                 title: str = "title", dims: int | None = None) -> DataFrame:
    """Chunk vectors of embeddable documents, the title in front of each chunk."""
    summary_col = F.col(summary) if summary else F.lit(None).cast("string")
    texts = docs.filter(is_embeddable(body, summary_col)).select(doc_id, title, embeddable_text(body, summary_col).alias("_text"))
    chunks = chunk(texts, doc_id=doc_id, text="_text", title=title)
    out = encode(chunks.withColumn("_body", F.col("chunk_text")), "_body", encoder, dims=dims)
    return out


def decode_vectors(df: DataFrame, blob: str = "embedding", dims: str = "dims") -> DataFrame:
    """Packed little-endian float32 to ``array<float>``; a vector of the wrong length is dropped."""
    fields = [f for f in df.schema.fields if f.name != blob]
    schema = T.StructType(fields + [T.StructField(blob, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.copy()
            frame[blob] = [np.frombuffer(b, dtype="<f4") if b is not None and len(b) % 4 == 0 else None for b in frame[blob]]
            yield frame

    return df.mapInPandas(run, schema).filter(F.size(blob) == F.col(dims))


def cosine(vector: str | Column, query: Sequence[float]) -> Column:
    """Dot product with one constant query vector (unit vectors: the cosine)."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    fixed = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, fixed, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def vector_topk(queries: DataFrame, vectors: DataFrame, *, query_id: str = "query_id", query_vector: str = "embedding",
                key: Sequence[str] = ("vec_id",), vector: str = "embedding", k: int = 20, min_similarity: float = 0.25,
                query_slice: int = QUERY_SLICE, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """Exact best ``k`` vectors per query at or above ``min_similarity``: ``(query_id, *key, similarity, rank_no)``.

    The vectors are read once, whatever the number of queries.  Up to ``query_slice`` queries travel to every task as one
    matrix and the vectors do not move.  More of them meet the vectors in tiles (``_near_tiles``).  Either way a task keeps the
    best ``k`` per query as it reads, so the last shuffle sees little else.  Null vectors are near to nothing; ties go by key.
    """
    key = list(key)
    asked = queries.filter(F.col(query_vector).isNotNull()).select(query_id, query_vector)
    stored = vectors.filter(F.col(vector).isNotNull()).select(*key, vector)
    out = T.StructType([asked.schema[query_id], *[stored.schema[c] for c in key], T.StructField("similarity", T.DoubleType())])
    few = asked.limit(query_slice + 1).collect()
    if len(few) <= query_slice:
        near = _near_slice(few, stored, out, len(key), k, min_similarity)
    else:
        near = _near_tiles(asked, stored, out, -(-asked.count() // tile_queries), k, min_similarity)
    order = W.partitionBy(query_id).orderBy(F.desc("similarity"), *key)
    return near.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= k)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)


class _Best:
    """The best ``k`` rows per query of all that were shown, and rows that tie with the last of them."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray, k: int, least: float, names: Sequence[str]):
        self.ids, self.matrix, self.k, self.names = ids, matrix, k, names
        self.floor = np.full(len(ids), float(least))
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Table]] = []
        self.rows, self.limit = 0, 2 * k * len(ids) + 65_536

    def show(self, keys: pa.Table, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, _CELLS // max(1, len(self.ids)))
        for at in range(0, len(vectors) if len(self.ids) else 0, step):
            scores = vectors[at:at + step] @ self.matrix.T
            row, query = np.nonzero(scores >= self.floor)
            if len(row):
                self.held.append((query, scores[row, query], keys.take(pa.array(row + at))))
                self.rows += len(row)
            if self.rows > self.limit:
                self._reduce()
                if self.rows > self.limit:  # ties alone: the final order decides among them
                    yield from self.give()

    def _reduce(self) -> None:
        query, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.ids)))
        last = first + self.k - 1
        full = last < np.append(first[1:], len(query))
        self.floor[full] = np.maximum(self.floor[full], score[last[full]])
        kept = score >= self.floor[query]
        keys = pa.concat_tables([h[2] for h in self.held]).take(pa.array(order[kept]))
        self.held, self.rows = [(query[kept], score[kept], keys)], int(kept.sum())

    def give(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self._reduce()
            query, score, keys = self.held[0]
            columns = [self.ids.take(pa.array(query)), *keys.columns, pa.array(score)]
            yield from pa.table(columns, names=list(self.names)).to_batches(max_chunksize=10_000)
        self.held, self.rows = [], 0


def _near_slice(few: list, vectors: DataFrame, out: T.StructType, n_key: int, k: int, least: float) -> DataFrame:
    """Candidates for at most a slice of queries: one narrow pass over the vectors."""
    ids, kind = [r[0] for r in few], to_arrow_type(out[0].dataType)
    matrix = np.array([r[1] for r in few], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(pa.array(ids, kind), matrix, k, least, out.names)
        for batch in batches:
            if len(batch) and ids:
                yield from best.show(pa.Table.from_batches([batch.select(list(range(n_key)))]), _matrix(batch.column(n_key)))
        yield from best.give()

    return vectors.mapInArrow(run, out)


def _near_tiles(queries: DataFrame, vectors: DataFrame, out: T.StructType, blocks: int, k: int, least: float) -> DataFrame:
    """Candidates for many queries: ``blocks`` of queries meet the vectors, cut into parts by a hash of the key, in a grid.

    A vector moves once per block of queries, a query once per part.  A cell of the grid reads its queries first, then its
    vectors as a stream sorted behind them: it holds the queries, the best rows and one Arrow batch, however many vectors there are.
    """
    query_id, query_vector = queries.columns
    *key, vector = vectors.columns
    parts = max(1, -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    n_key = len(key)
    # columns by place: names of queries and vectors may be the same
    asked = queries.select(F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_r"),
                           F.lit(0).alias("_side"), F.col(query_id).alias("_id"), F.col(query_vector).alias("_q"),
                           *[F.lit(None).cast(vectors.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(key)],
                           F.lit(None).cast(vectors.schema[vector].dataType).alias("_v"))
    shown = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_c"), F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("_r"),
                           F.lit(1).alias("_side"), F.lit(None).cast(queries.schema[query_id].dataType).alias("_id"),
                           F.lit(None).cast(queries.schema[query_vector].dataType).alias("_q"),
                           *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col(vector).alias("_v"))
    cells = asked.union(shown).repartition("_c", "_r").sortWithinPartitions("_c", "_r", "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, matrices, best = None, [], [], None
        for batch in batches:
            if not len(batch):
                continue
            place = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            starts = np.append(0, np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1)
            for at, end in zip(starts, np.append(starts[1:], len(place))):
                rows = batch.slice(at, end - at)
                if cell != tuple(place[at, :2]):
                    if best:
                        yield from best.give()
                    cell, ids, matrices, best = tuple(place[at, :2]), [], [], None
                if place[at, 2] == 0:
                    ids.append(rows.column(3))
                    matrices.append(_matrix(rows.column(4)))
                elif ids:
                    best = best or _Best(pa.concat_arrays(ids), np.concatenate(matrices), k, least, out.names)
                    yield from best.show(pa.Table.from_batches([rows.select(list(range(5, 5 + n_key)))]), _matrix(rows.column(5 + n_key)))
        if best:
            yield from best.give()

    return cells.mapInArrow(run, out)
