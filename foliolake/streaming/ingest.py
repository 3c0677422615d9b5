"""Incremental ingest with Structured Streaming: arriving documents run through the batch operators.

Checkpoint and output belong in shared storage.  Every write is keyed by its batch id and
overwrites that batch's folder, so a batch that runs again after a loss leaves the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.entities import mention_rows, regex_entities
from ..operators.paging import paginate
from ..operators.pii import scan_pii
from ..operators.impact import sorted_postings
from ..operators.search import BUCKET, build_index, in_buckets
from ..operators.vectors import embed_pages
from ..functions.text import content_hash
from ..sources import generations
from ..sources.store import keep_one


def not_yet_done(inputs: DataFrame, outputs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Resume rule in batch form: inputs whose output exists are skipped."""
    return inputs.join(outputs.select(*key), list(key), "left_anti")


def arriving(spark: SparkSession, folder: str, schema: T.StructType, *, pattern: str | None = None,
             files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def derived_tables(docs: DataFrame, *, separator: str = "\n\n") -> dict[str, DataFrame]:
    """All tables an ingest derives from ``docs(doc_id, text)``: the same code batch and stream run."""
    pages = paginate(docs.select("doc_id", "text"), separator=separator)
    postings, doclens = build_index(pages, ["doc_id", "page_number"], "text_content")
    return {
        "pages": pages,
        "entities": mention_rows(regex_entities(docs.select("doc_id", "text"))),
        "pii": scan_pii(pages.select("doc_id", "page_number", "text_content")),
        "postings": postings,
        "doclens": doclens,
        "hashes": docs.select("doc_id", content_hash("text").alias("content_hash")),
    }


def ingest_stream(docs: DataFrame, out: str, checkpoint: str, *, separator: str = "\n\n",
                  extra: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs what has arrived and stops (``availableNow``); call again for later arrivals.

    Every document is expected once; ``replacing_stream`` is for those that come again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, table in derived_tables(batch, separator=separator).items():
                table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
            if extra:
                extra(batch, batch_id)
        finally:
            batch.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def case_store(folder: str) -> generations.Store:
    """Segments of the ingest's tables; postings lie in folders by a hash of the term, as in a stored index.

    Nothing moves once the arrivals of a document have met: postings are cut and sorted by the task that reads their pages.
    """
    unit = ["doc_id", "page_number"]
    return generations.Store(folder, "doc_id", {"pages": unit, "postings": ["term", *unit]}, {"postings": BUCKET}, ["postings"])


def replaceable_tables(*, separator: str = "\n\n") -> dict[str, Callable[[dict], DataFrame]]:
    """The tables of ``derived_tables`` for a store in segments; pages are cut once, the rest starts from the written ones."""
    unit = ["doc_id", "page_number"]
    return {
        "pages": lambda t: paginate(t["sent"].select("doc_id", "text"), separator=separator),
        "entities": lambda t: mention_rows(regex_entities(t["sent"].select("doc_id", "text"))).withColumnRenamed("document_id", "doc_id"),
        "pii": lambda t: scan_pii(t["pages"].select(*unit, "text_content")),
        "postings": lambda t: in_buckets(sorted_postings(t["pages"], unit, "text_content").select("term", *unit, "tf", "positions")),
        "doclens": lambda t: build_index(t["pages"], unit, "text_content")[1],
        "hashes": lambda t: t["sent"].select("doc_id", content_hash("text").alias("content_hash")),
    }


def replacing_stream(docs: DataFrame, store: generations.Store, checkpoint: str, *, order: str, deleted: str | None = None,
                     tables: dict[str, Callable[[dict], DataFrame]] | None = None, fan: int = 8) -> StreamingQuery:
    """Like ``ingest_stream``, but a document that comes again replaces all it had, and one marked ``deleted`` leaves.

    A later batch replaces an earlier one; within a batch the highest ``order`` wins (null is lowest, then a hash of the row
    decides).  Documents without ``doc_id`` are left out.  The store is compacted as segments gather.
    """
    made = replaceable_tables() if tables is None else tables

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = keep_one(batch, [store.key], order, policy="replace")
        generations.write(spark, store, batch_id, newest, made, deleted=deleted)
        while run := generations.due(generations.spans(spark, store), fan):
            generations.compact(spark, store, *run)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embedding_stream(pages: DataFrame, encoder: Callable, out: str, checkpoint: str) -> StreamingQuery:
    """Vectors for pages as they arrive; the checkpoint remembers which pages were embedded."""

    def write(batch: DataFrame, batch_id: int) -> None:
        embed_pages(batch, encoder).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(events: DataFrame, key: Sequence[str], time: str, *, lateness: str = "1 hour") -> DataFrame:
    """Arrivals with repeats of a key dropped while the watermark still remembers it."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return stamped.dropDuplicatesWithinWatermark(list(key))
