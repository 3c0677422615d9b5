"""Conversation history, stage ledger, resumable and streaming ingest over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import retrieval
from ..session import work_folder
from ..sources import generations, store
from ..streaming import ingest, ledger
from .bindings import BLANKS, LINKS, PAGES, document_persons, documents, lit, pages, sql_normalise, sql_strip, sql_tokens, table
from .registry import query

# --- conversations ----------------------------------------------------------------------------


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4 AS recent FROM conversations""")
def history_split(spark, sf):
    return retrieval.split_history(table(spark, sf, "conversations"), max_turns=2).select("conv_id", "turn", "recent")


_LINES_SQL = f"""n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS e FROM conversations),
 p AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM n WHERE e > 2),
 lines AS (SELECT conv_id, turn, 'Q: ' || {sql_strip('substr(text, 1, 150)')} || chr(10) || 'A: ' || {sql_strip('substr(nt, 1, 600)')} || CASE WHEN length(nt) > 600 THEN '...' ELSE '' END || chr(10) AS line
  FROM p WHERE role = 'user' AND nr = 'assistant')"""


@query(f"WITH {_LINES_SQL} SELECT * FROM lines")
def history_lines(spark, sf):
    return retrieval.history_lines(table(spark, sf, "conversations"), max_turns=1)


@query(f"""WITH {_LINES_SQL}, lo AS (SELECT DISTINCT conv_id FROM n WHERE e > 2)
 SELECT conv_id, 0 AS part, 0 AS seq, 'user' AS role, md5({lit(V.HISTORY_HEADER)}) AS content_md5 FROM lo UNION ALL SELECT conv_id, 1, turn, 'user', md5(line) FROM lines
 UNION ALL SELECT conv_id, 2, 0, 'assistant', md5({lit(V.HISTORY_ACK)}) FROM lo UNION ALL SELECT conv_id, 3, turn, role, md5(text) FROM n WHERE e <= 2""")
def prompt_context(spark, sf):
    rows = retrieval.prompt_context(table(spark, sf, "conversations"), max_turns=1)
    return rows.select("conv_id", "part", "seq", "role", F.md5("content").alias("content_md5"))


# --- ledger and resume ------------------------------------------------------------------------


def _marks(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.md5(F.col("user_id").cast("string")).alias("file_hash"), F.col("event_type").alias("stage"),
                    F.concat(F.lit("/out/"), F.col("event_id").cast("string")).alias("result_path"), F.col("ts").alias("completed_at"))


def _ledger(spark, sf):
    m = _marks(spark, sf)
    even = F.pmod("event_id", F.lit(2)) == 0
    return ledger.mark(m.filter(even).drop("event_id"), m.filter(~even).drop("event_id"))


_LEDGER_SQL = """led AS (SELECT md5(CAST(user_id AS VARCHAR)) AS file_hash, event_type AS stage, arg_max('/out/' || event_id, ts) AS result_path, max(ts) AS completed_at FROM events GROUP BY ALL)"""


@query(f"WITH {_LEDGER_SQL} SELECT file_hash, stage, result_path, completed_at FROM led")
def ledger_upsert(spark, sf):
    return _ledger(spark, sf)


@query(f"WITH {_LEDGER_SQL} SELECT stage, count(*) AS n FROM led WHERE stage <> 'view' GROUP BY 1")
def ledger_stage_counts(spark, sf):
    return ledger.stage_counts(ledger.clear_stage(_ledger(spark, sf), "view"))


@query(f"WITH {_LEDGER_SQL} SELECT md5(CAST(c_custkey AS VARCHAR)) AS file_hash FROM customer WHERE md5(CAST(c_custkey AS VARCHAR)) NOT IN (SELECT file_hash FROM led WHERE stage = 'purchase')")
def ledger_unprocessed(spark, sf):
    inputs = table(spark, sf, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("file_hash"))
    return ledger.unprocessed(inputs, _ledger(spark, sf), "purchase")


@query(f"WITH {_LEDGER_SQL} SELECT file_hash, stage, result_path FROM led WHERE file_hash = md5('7') AND stage = 'click'")
def ledger_lookup(spark, sf):
    import hashlib

    return ledger.is_processed(_ledger(spark, sf), hashlib.md5(b"7").hexdigest(), "click").drop("completed_at")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_inputs(spark, sf):
    return ingest.not_yet_done(documents(spark, sf).select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


# --- streams ----------------------------------------------------------------------------------


def _arriving(spark, sf, name):
    """The table as a stream, whether it is one file or a folder of files; a stream takes a single file only where a pattern names it."""
    return ingest.arriving(spark, f"{sf}/[{name[0]}]{name[1:]}.parquet", table(spark, sf, name).schema)


def _ingested(spark, sf):
    folder = work_folder(spark, "ingest")
    q = ingest.ingest_stream(_arriving(spark, sf, "documents").select("doc_id", "text"), f"{folder}/out", f"{folder}/checkpoint", separator="\n")
    q.awaitTermination()
    return f"{folder}/out"


@query(f"WITH {PAGES} SELECT doc_id, page_number, length(text_content) AS char_count FROM doc_pages")
def stream_ingest_pages(spark, sf):
    """Documents through the streaming ingest; its page table equals the batch result."""
    out = _ingested(spark, sf)
    return spark.read.parquet(f"{out}/pages").select("doc_id", "page_number", "char_count")


@query(f"""WITH {PAGES}, x AS (SELECT doc_id, page_number, unnest({sql_tokens('text_content')}) AS term FROM doc_pages)
 SELECT term, count(*) AS tf, count(DISTINCT (doc_id, page_number)) AS df FROM x GROUP BY 1""")
def stream_ingest_index(spark, sf):
    out = _ingested(spark, sf)
    return spark.read.parquet(f"{out}/postings").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


_SECOND = "\nThis text was sent a second time."

#: Documents as they stand after all arrivals of ``_rearrived``.
_LATEST_SQL = f"""late AS (SELECT doc_id, lang, source, CASE WHEN lang = 'en' THEN text ELSE text || {lit(_SECOND)} END AS text FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))"""
_LATEST_PAGES_SQL = PAGES.replace("FROM documents", "FROM late")


def _rearrived(spark, sf, tables):
    """Three arrivals through the stream: all documents; those not in English once more, longer; those labelled toxic withdrawn.

    The store compacts the first two segments when the second is there, and gives the store.
    """
    docs = documents(spark, sf).select("doc_id", "lang", "text")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    sends = [docs, docs.filter("lang <> 'en' or lang is null").withColumn("text", F.concat("text", F.lit(_SECOND))),
             docs.join(toxic, "doc_id", "left_semi")]
    folder = work_folder(spark, "arrivals")
    kept = ingest.case_store(f"{folder}/store")
    for n, sent in enumerate(sends):
        marked = sent.select("doc_id", "text", F.lit(n).alias("arrived"), F.lit(n == 2).alias("withdrawn"))
        marked.write.mode("append").parquet(f"{folder}/in")
        # as many files as there are make one batch
        came = ingest.arriving(spark, f"{folder}/in", marked.schema, files_per_trigger=1_000_000)
        ingest.replacing_stream(came, kept, f"{folder}/checkpoint", order="arrived", deleted="withdrawn", tables=tables, fan=2).awaitTermination()
    return kept


@query(f"WITH {_LATEST_SQL}, {_LATEST_PAGES_SQL} SELECT doc_id, page_number, md5(text_content) AS page_md5 FROM doc_pages")
def stream_rearrival_pages(spark, sf):
    """Pages after documents came again and went: one set each, as if only the last text had been sent."""
    made = ingest.replaceable_tables(separator="\n")
    kept = _rearrived(spark, sf, {"pages": made["pages"]})
    return generations.live(spark, kept, "pages").select("doc_id", "page_number", F.md5("text_content").alias("page_md5"))


@query(f"""WITH {_LATEST_SQL}, {_LATEST_PAGES_SQL}, x AS (SELECT doc_id, page_number, unnest({sql_tokens('text_content')}) AS term FROM doc_pages)
 SELECT term, count(*) AS tf, count(DISTINCT (doc_id, page_number)) AS df FROM x GROUP BY 1""")
def stream_rearrival_index(spark, sf):
    """Counts of every term over the postings that hold after documents came again and went."""
    made = ingest.replaceable_tables(separator="\n")
    kept = _rearrived(spark, sf, {name: made[name] for name in ("pages", "postings")})
    return generations.live(spark, kept, "postings").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_arrivals(spark, sf):
    folder = work_folder(spark, "arrivals")
    first = ingest.first_arrivals(_arriving(spark, sf, "events"), ["user_id", "event_type"], "ts", lateness="365 days")
    q = first.select("user_id", "event_type").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(f"WITH {PAGES} SELECT doc_id, page_number, 64 AS dims FROM doc_pages WHERE length(text_content) > 20")
def stream_embeddings(spark, sf):
    from ..operators.paging import paginate
    from ..operators.vectors import hashing_encoder

    folder = work_folder(spark, "vectors")
    arriving = paginate(_arriving(spark, sf, "documents"), separator="\n")
    ingest.embedding_stream(arriving, hashing_encoder(64), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "page_number", "dims")


# --- sinks ------------------------------------------------------------------------------------


@query(f"""WITH {PAGES} SELECT d.doc_id, d.lang, p.page_number, md5(p.text_content) AS page_md5, md5(d.text) AS text_md5
 FROM documents d LEFT JOIN doc_pages p ON p.doc_id = d.doc_id""")
def store_round_trip(spark, sf):
    """Every row of both tables as the store gives it back."""
    folder = work_folder(spark, "store")
    store.write_store({"documents": documents(spark, sf), "pages": pages(spark, sf)}, folder,
                      cluster_by={"documents": ["doc_id"], "pages": ["doc_id", "page_number"]})
    d, p = (spark.read.parquet(f"{folder}/{t}") for t in ("documents", "pages"))
    joined = d.select("doc_id", "lang", F.md5("text").alias("text_md5")).join(p.select("doc_id", "page_number", F.md5("text_content").alias("page_md5")), "doc_id", "left")
    return joined.select("doc_id", "lang", "page_number", "page_md5", "text_md5")


@query(f"""WITH {PAGES} SELECT d.doc_id, d.lang, d.source, p.page_number, length(p.text_content) AS char_count FROM doc_pages p JOIN documents d ON d.doc_id = p.doc_id""")
def store_buckets(spark, sf):
    """Pages and their documents from tables in buckets, joined without an exchange."""
    name = f"case_{uuid.uuid4().hex}"
    saved = store.save_bucketed({"documents": documents(spark, sf).select("doc_id", "lang", "source"), "pages": pages(spark, sf)},
                                work_folder(spark, "buckets"), by=["doc_id"], buckets=16, prefix=name)
    d, p = (spark.table(saved[t]) for t in ("documents", "pages"))
    return p.join(d.hint("merge"), "doc_id").select("doc_id", "lang", "source", "page_number", "char_count")


@query(f"""WITH {LINKS} SELECT 'link' AS kind, a.person_id AS source, b.person_id AS target, 'co-occurrence' AS type, count(*)::DOUBLE AS weight, NULL AS label
  FROM links a JOIN links b ON a.doc_id = b.doc_id AND a.person_id < b.person_id GROUP BY ALL
 UNION ALL SELECT DISTINCT 'node', person_id, NULL, 'person', NULL, CAST(person_id AS VARCHAR) FROM links""")
def graph_round_trip(spark, sf):
    """Links and nodes as the files give them back."""
    from ..operators import graph

    folder = work_folder(spark, "graph")
    links = document_persons(spark, sf)
    store.write_graph(graph.person_nodes(links), graph.document_edges(links), folder)
    edges = spark.read.schema("source bigint, target bigint, type string, weight double").json(f"{folder}/links").withColumn("kind", F.lit("link"))
    nodes = spark.read.schema("id bigint, label string, type string").json(f"{folder}/nodes").withColumn("kind", F.lit("node"))
    return edges.unionByName(nodes.withColumnRenamed("id", "source"), allowMissingColumns=True)


@query(f"""WITH h AS (SELECT doc_id, sha256({sql_normalise('text')}) AS hash FROM documents WHERE {sql_strip('text')} <> '' AND split_part(text, chr(10), 1) <> ''),
 g AS (SELECT hash, min(doc_id) AS id_1 FROM h GROUP BY 1) SELECT id_1, doc_id AS id_2, 1.0::DOUBLE AS score FROM h JOIN g USING (hash) WHERE doc_id <> id_1""")
def report_round_trip(spark, sf):
    from ..operators import dedup
    from .bindings import titled

    folder = work_folder(spark, "report")
    store.write_json(dedup.hash_links(dedup.dedup_records(titled(spark, sf))), folder)
    return spark.read.schema("id_1 bigint, id_2 bigint, score double").json(folder)


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS title, CASE WHEN doc_id % 2 = 0 THEN '/in/' || doc_id || '.pdf' END AS file_path, md5(text) AS text_md5 FROM documents""")
def record_documents_round_trip(spark, sf):
    """Documents written as extraction records, every second one nested, and read back."""
    from ..sources import records

    folder = work_folder(spark, "records")
    key = F.col("doc_id").cast("string")
    doc = F.struct(key.alias("id"), F.col("lang").alias("title"), F.col("text").alias("ocrText"))
    nested = F.to_json(F.struct(F.concat(F.lit("/in/"), key, F.lit(".pdf")).alias("source_path"), doc.alias("document")))
    documents(spark, sf).select(F.when(F.pmod("doc_id", F.lit(2)) == 0, nested).otherwise(F.to_json(doc))).write.text(folder)
    got = records.record_documents(records.read_records(spark, folder, one_per_file=False))
    return got.select("doc_id", "title", "file_path", F.md5("text").alias("text_md5"))
