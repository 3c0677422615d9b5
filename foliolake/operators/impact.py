"""A stored index whose postings lie in blocks by impact, with all numbers of the corpus beside them.

* ``postings``: term, unit, ``tf``, ``positions`` and ``n_tokens`` of the unit, in folders by a hash of the term; every task sorts the
  postings of its own units by term and falling impact, none is shuffled; ``block`` numbers runs of ``BLOCK`` postings.  What a
  score needs of a unit is in the posting.  Only bounds and pruning rest on the order, no result does.
* ``blocks``, in the same folders: per term and block the number of postings, their ``tf`` in all, the largest ``tf`` and the shortest unit,
  which bound every score in it.  The counts of a term's blocks are its document frequency.
* ``vocabulary``: document frequency by corpus and term.
* ``corpus``: units and tokens per group (corpus and data set).

``find`` gives all matches.  ``best`` gives the first ``k`` without reading the postings of blocks that cannot hold any of
them: matches from the first blocks of the rarest term set a score to beat, and only blocks that may beat it are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import fixed_values as V
from ..functions.text import tokens
from ..sources.store import write_store
from .search import BUCKET, TERM_BUCKETS, bm25_term, bucket_of, fold_terms, idf

#: Columns that name the part of the corpus a unit belongs to; scores are worked out within one or both.
GROUPS = ["corpus", "dataset"]
#: Postings in a block (a power of two: bits of the row number are cut off), and how many blocks' worth sets the score to beat.
BLOCK_BITS, TRIED = 10, 4
#: Units that are worth a task of their own while an index is written, and tokens after which a task cuts what it has read.
TASK_UNITS, CUT_TOKENS = 8192, 2_000_000
#: Postings that a task hands back at a time.
CUT_ROWS = 50_000
#: Length of unit that postings are sorted for.  Bounds do not depend on it, only how well blocks part high from low scores.
TYPICAL_TOKENS = 300
#: Ranks are compared rounded to nine places.
_TINY = 1e-8


class Index(NamedTuple):
    postings: DataFrame
    blocks: DataFrame
    vocabulary: DataFrame
    corpus: DataFrame
    unit: list[str]
    buckets: int


def write_index(units: DataFrame, unit: Sequence[str], text: str, folder: str, *, buckets: int = TERM_BUCKETS, bits: int = BLOCK_BITS) -> None:
    """Index of ``units(*GROUPS, *unit, text)``: tokens are cut once, and postings stay in the task that reads their unit."""
    unit, spark = list(unit), units.sparkSession
    tasks = 1 + units.count() // TASK_UNITS  # every task writes a file per folder: few units, few tasks
    postings = sorted_postings(units.coalesce(tasks), [*GROUPS, *unit], text).withColumn(BUCKET, bucket_of(F.col("term"), buckets))
    # one short key: within a folder the rows keep the order they were cut in
    placed = postings.sortWithinPartitions(BUCKET).withColumn("block", F.shiftright(F.monotonically_increasing_id(), bits))
    placed.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    blocks = postings.groupBy("term", *GROUPS, "block", BUCKET).agg(
        F.count("*").alias("n"), F.sum("tf").alias("tf"), F.max("tf").alias("top_tf"), F.min("n_tokens").alias("least_tokens"))
    blocks.sortWithinPartitions(BUCKET, "term", "block").write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    n_tokens = blocks.groupBy(*GROUPS).agg(F.sum("tf").alias("n_tokens"))
    n_units = units.groupBy(*GROUPS).agg(F.count("*").alias("n_units"))
    corpus = n_units.join(n_tokens, GROUPS, "left").select(*GROUPS, "n_units", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    vocabulary = blocks.groupBy("corpus", "term").agg(F.sum("n").alias("df")).sortWithinPartitions("term", "corpus")
    write_store({"corpus": corpus, "vocabulary": vocabulary}, folder)


def sorted_postings(units: DataFrame, unit: Sequence[str], text: str) -> DataFrame:
    """``(term, *unit, n_tokens, tf, positions)`` as ``row_postings``, those of a task's units by term and falling impact.

    Tokens are cut by Spark; a task numbers its terms and sorts numbers, not rows.
    """
    keys = list(unit)
    listed = units.select(*keys, tokens(text).alias("_t"))
    fields = {f.name: f for f in listed.schema}
    schema = T.StructType([T.StructField("term", T.StringType()), *[fields[c] for c in keys], T.StructField("n_tokens", T.IntegerType()),
                           T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("_t").flatten())
            if size >= CUT_TOKENS:
                yield from _cut(pa.Table.from_batches(held), keys)
                held, size = [], 0
        if held:
            yield from _cut(pa.Table.from_batches(held), keys)

    return listed.mapInArrow(run, schema)


def _cut(read, keys: Sequence[str]) -> Iterator:
    """Arrow batches of the postings of ``read(*keys, _t)``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    read = read.combine_chunks()
    listed = read.column("_t").chunk(0) if read.num_rows else pa.array([], pa.list_(pa.string()))
    sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbered = listed.flatten().dictionary_encode()
    if not len(numbered):
        return
    terms = numbered.dictionary
    in_order = pc.sort_indices(terms).to_numpy()
    rank = np.empty(len(terms), np.int64)
    rank[in_order] = np.arange(len(terms))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = rank[numbered.indices.to_numpy()] * len(sizes) + row
    by_key = np.argsort(key, kind="stable")
    key = key[by_key]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tf = np.diff(np.r_[first, len(key)])
    of_term, of_row = np.divmod(key[first], len(sizes))
    norm = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * sizes[of_row] / TYPICAL_TOKENS)
    best_first = np.lexsort((of_row, -tf / (tf + norm), of_term))
    positions = pa.ListArray.from_arrays(np.r_[first, len(key)].astype(np.int32), place[by_key].astype(np.int32))
    for at in range(0, len(best_first), CUT_ROWS):
        some = best_first[at:at + CUT_ROWS]
        units = pa.array(of_row[some])
        columns = {"term": terms.take(pa.array(in_order[of_term[some]]))} | {k: read.column(k).chunk(0).take(units) for k in keys}
        columns |= {"n_tokens": pa.array(sizes[of_row[some]].astype(np.int32)), "tf": pa.array(tf[some]), "positions": positions.take(pa.array(some))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def open_index(spark: SparkSession, folder: str, unit: Sequence[str], *, buckets: int = TERM_BUCKETS) -> Index:
    """``buckets`` as the index was written with: reading with another number would look in the wrong folders."""
    postings, blocks, vocabulary, corpus = (spark.read.parquet(f"{folder}/{t}") for t in ("postings", "blocks", "vocabulary", "corpus"))
    return Index(postings, blocks, vocabulary, corpus, list(unit), buckets)


def _only(ix: Index, terms: Sequence[str], where: Column | None) -> tuple[DataFrame, DataFrame]:
    """Postings and blocks of exact terms; their folders are constants that the optimizer works out, without a job."""
    held = F.col(BUCKET).isin([bucket_of(F.lit(t), ix.buckets) for t in terms]) if terms else F.lit(False)
    mine = F.col("term").isin(list(terms)) if terms else F.lit(False)
    if where is not None:
        mine = mine & where
    return ix.postings.filter(held & mine), ix.blocks.filter(held & mine)


def _number(terms: Sequence[str]) -> Column:
    """The place of the term among the exact query terms."""
    number = F.lit(None).cast("int")
    for i, t in enumerate(terms):
        number = F.when(F.col("term") == t, i).otherwise(number)
    return number


def _stats(ix: Index, by: Sequence[str], where: Column | None) -> DataFrame:
    corpus = ix.corpus if where is None else ix.corpus.filter(where)
    return corpus.groupBy(*by).agg(F.sum("n_units").alias("_units"), (F.sum("n_tokens") / F.sum("n_units")).alias("_mean"))


def _scored(rows: DataFrame, df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    score = bm25_term(F.col("tf"), F.col("n_tokens"), F.col("_mean"), idf(F.col("_units"), F.col("df")))
    return rows.join(df, [*by, "i"]).join(stats, list(by)).withColumn("score", score)


def find(ix: Index, terms: Sequence[str], *, by: Sequence[str] = ("corpus",), mode: str = "all", where: Column | None = None) -> DataFrame:
    """``(*GROUPS, *unit, rank)`` of every match; ``by`` names the groups within which the numbers of the corpus are taken.

    ``term*`` stands for all terms it begins, which ``vocabulary`` names.  ``where`` is a condition on the groups.
    """
    terms, by = fold_terms(terms), list(by)
    exact = [t for t in terms if not t.endswith("*")]
    prefixes = [t[:-1] for t in terms if t.endswith("*")]
    postings, blocks = _only(ix, exact, where)
    cols = [*GROUPS, *ix.unit, "tf", "n_tokens"]
    rows = postings.select(*cols, _number(exact).alias("i"))
    df = blocks.select(*by, "n", _number(exact).alias("i")).groupBy(*by, "i").agg(F.sum("n").alias("df"))
    if prefixes:
        starts = F.filter(F.array(*[F.when(F.col("term").startswith(p), len(exact) + i) for i, p in enumerate(prefixes)]), lambda i: i.isNotNull())
        begun = F.lit(False)
        for p in prefixes:
            begun = begun | F.col("term").startswith(p)
        known = ix.vocabulary.filter(begun).select("term").distinct().select(bucket_of(F.col("term"), ix.buckets).alias(BUCKET), "term", F.explode(starts).alias("i"))
        all_of = ix.postings if where is None else ix.postings.filter(where)
        more = all_of.join(known, [BUCKET, "term"]).groupBy(*GROUPS, *ix.unit, "n_tokens", "i").agg(F.sum("tf").alias("tf")).select(*cols, "i")
        rows = rows.unionByName(more)
        df = df.unionByName(more.groupBy(*by, "i").agg(F.count("*").alias("df")))
    scored = _scored(rows, df, _stats(ix, by, where), by)
    ranked = scored.groupBy(*GROUPS, *ix.unit).agg(F.sum("score").alias("rank"), F.count("*").alias("_got"))
    return (ranked.filter(F.col("_got") == len(terms)) if mode == "all" else ranked).drop("_got")


def best(ix: Index, terms: Sequence[str], k: int, *, by: Sequence[str] = ("corpus",), where: Column | None = None) -> DataFrame:
    """The ``k`` best matches of all (exact) terms in every group of ``by``, with ``position`` from 1: the same as of ``find``."""
    terms, by = fold_terms(terms), list(by)
    if any(t.endswith("*") for t in terms):
        raise ValueError("block bounds are kept per term: use find for prefixes")
    postings, blocks = _only(ix, terms, where)
    number, stats = _number(terms), _stats(ix, by, where)
    df = blocks.select(*by, "n", number.alias("i")).groupBy(*by, "i").agg(F.sum("n").alias("df"))
    bounds = blocks.withColumn("i", number).join(df, [*by, "i"]).join(stats, by).withColumn(
        "bound", -bm25_term(F.col("top_tf"), F.col("least_tokens"), F.col("_mean"), idf(F.col("_units"), F.col("df"))))
    # per group: the rarest term to enter by, and what all others can add at most
    per_term = bounds.groupBy(*by, "i").agg(F.max("df").alias("df"), F.max("bound").alias("most"))
    entry = per_term.groupBy(*by).agg(F.min_by("i", F.struct("df", "i")).alias("i"), F.sum("most").alias("_all"), F.count("*").alias("_terms"),
                                      F.min_by("most", F.struct("df", "i")).alias("_own")).filter(F.col("_terms") == len(terms))
    entered = bounds.join(entry, [*by, "i"]).withColumn("bound", F.col("bound") + F.col("_all") - F.col("_own"))
    entered = entered.select(*GROUPS, "term", "block", "n", "bound", BUCKET)
    order = W.partitionBy(*by).orderBy(F.desc("bound"), "block", *GROUPS).rowsBetween(W.unboundedPreceding, -1)
    tried = entered.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("_before") < TRIED * k)

    def matches(chosen: DataFrame) -> DataFrame:
        on = [BUCKET, "term", "block", *GROUPS]
        first = postings.join(chosen.select(*on), on).select(*GROUPS, *ix.unit, "tf", "n_tokens", number.alias("i"))
        others = first.select(*GROUPS, *ix.unit, F.col("i").alias("_entry")).join(
            postings.select(*GROUPS, *ix.unit, "tf", "n_tokens", number.alias("i")), [*GROUPS, *ix.unit]).filter("i <> _entry").drop("_entry")
        scored = _scored(first.unionByName(others) if len(terms) > 1 else first, df, stats, by)
        ranked = scored.groupBy(*GROUPS, *ix.unit).agg(F.sum("score").alias("rank"), F.count("*").alias("_got"))
        place = W.partitionBy(*by).orderBy(F.round("rank", 9), *ix.unit, *[c for c in GROUPS if c not in by])
        full = ranked.filter(F.col("_got") == len(terms)).drop("_got")
        return full.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= k)

    beaten = matches(tried).filter(F.col("position") == k).select(*by, (-F.col("rank")).alias("_least"))
    chosen = entered.join(beaten, by, "left").filter(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - _TINY))
    return matches(chosen)
