"""What larger inputs brought up: tables in folders, letters beyond ASCII, plans that must not grow."""

import duckdb
import pytest
from pyspark.sql import functions as F

from foliolake import plans
from foliolake.operators import pii, questions, ranges, search

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def in_folders(spark, tmp_path_factory):
    """Documents and events as folders of several files, as large tables are."""
    at = tmp_path_factory.mktemp("folders")
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["stream_ingest_pages", "stream_ingest_index", "stream_embeddings", "stream_first_arrivals"])
def test_streams_read_tables_in_folders(spark, in_folders, name):
    run = plans.queries()[name]
    assert sorted(map(tuple, run(spark, in_folders).collect())) == sorted(map(tuple, run(spark, SF).collect()))


def test_personal_data_ends_words_as_its_sql(spark, tmp_path):
    """``st`` before an umlaut: two words to the SQL, one word to the operator unless it is asked."""
    texts = [(10, "0199 Und eintzie stä dieens"), (14, "12 Old Mill Roadé and 12 Old Mill Road"), (9, "café 212-555-0147é a@b.org"), (7, "été 3, 1999")]
    docs = spark.createDataFrame([(k, t, "de", "x", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("pii_scan", "pii_summary", "pii_redact", "pii_redact_index", "pii_tier_one", "pii_dry_run"):
        assert compare(plans.queries()[name](spark, str(tmp_path)), con, plans.oracle_sql()[name]) is None, name
    pages = docs.select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("text_content"))
    found = pii.scan_pii(pages.filter("doc_id in (10, 14)"), kinds=["address"])
    assert [r.match_text for r in found.collect()] == ["12 Old Mill Road"]


def test_overlaps_of_chosen_ranges_are_never_broadcast(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("AB").alias("prefix"), (F.col("id") * 3).alias("lo"), (F.col("id") * 3 + F.col("id") % 9).alias("hi"))
    got = ranges.overlaps_of(rows, rows.filter("doc_id % 5 = 0"))
    want = {(a, b) for a in range(0, 200, 5) for b in range(200) if a != b and b * 3 <= a * 3 + a % 9 and a * 3 <= b * 3 + b % 9}
    assert {tuple(r) for r in got.collect()} == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_queries_of_the_same_terms_are_searched_for_once(spark, monkeypatch):
    words = ["wire", "bank", "memo", "road"]
    pages = spark.createDataFrame([(d, 1, " ".join(words[i] for i in range(4) if d >> i & 1) + " x" * (d % 5)) for d in range(1, 48)],
                                  "doc_id long, page_number int, text_content string")
    postings, doclens = search.build_index(pages, ["doc_id", "page_number"], "text_content")
    ways = [["wire"], ["wire", "bank"], ["bank", "wire"], ["wire", "bank", "memo"], ["none", "wire"]]
    asked = spark.createDataFrame([(f"q{n}", no, t) for n in range(30) for no, w in enumerate(ways) for t in w], "question_id string, query_no int, term string")
    sent = []

    def spied(p, d, wanted, unit, *, query, **more):
        sent.append(wanted.select(*query).distinct().count())
        return search.search(p, d, wanted, unit, query=query, **more)

    monkeypatch.setattr(questions, "search", spied)
    got = {tuple(r) for r in questions.find_pages(postings, doclens, asked).select("question_id", "query_no", "doc_id", "page_number", F.round("rank", 9)).collect()}
    assert sent == [4]
    ranked = search.search(postings, doclens, asked, ["doc_id", "page_number"], query=["question_id", "query_no"])
    best = search.top_k(ranked, 10, [F.round("rank", 9), F.col("doc_id"), F.col("page_number")], by=["question_id", "query_no"])
    each = {}
    for r in sorted(best.collect(), key=lambda r: (r.question_id, r.query_no, r.position)):
        each.setdefault((r.question_id, r.doc_id), (r.question_id, r.query_no, r.doc_id, r.page_number, round(r["rank"], 9)))
    assert got == set(each.values())
    # BM25 over the text itself, term by term
    for w in ([["wire"], ["wire", "bank"], ["wire", "bank", "memo"]]):
        plain = {(r.doc_id, round(r["rank"], 7)) for r in search.search_text(pages, "text_content", w).collect()}
        one = spark.createDataFrame([("q", t) for t in w], "query_id string, term string")
        assert {(r.doc_id, round(r["rank"], 7)) for r in search.search(postings, doclens, one, ["doc_id", "page_number"]).collect()} == plain
