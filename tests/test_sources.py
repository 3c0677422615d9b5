"""Files, records, registry, store and streams in a temporary folder."""

import json
import struct

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from foliolake import schemas
from foliolake.operators import stats, vectors
from foliolake.session import cut_lineage
from foliolake.sources import files, records, store
from foliolake.streaming import ingest, ledger

TEXTS = {
    "finance_report.txt": "Wire of 5,000 from ann@bank.org.\nCall 212-555-0147 today.", "memo-one.md": "SSN 123-45-6789 born 3/4/1975\n12 Old Mill Road",
    "notice.csv": "clean notice", "blank.txt": "  \n ", "skip.bin": "x",
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i, (name, text) in enumerate(TEXTS.items()):
        (tmp_path / "in" / ("deep" if i % 2 else "") / name).write_text(text)
    return tmp_path


def test_discover_and_census(spark, folder):
    found = files.discover(spark, str(folder / "in"))
    assert found.count() == 5 and files.discover(spark, str(folder / "in"), ["txt"]).count() == 2
    assert {r.family: r.n for r in stats.file_census(found).collect()} == {"text": 4, "other": 1, "total": 5}
    assert {r.family: r.n for r in stats.file_census(found, keep_unknown=True).collect()} == {"text": 4, "bin": 1, "total": 5}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_text_documents(spark, folder):
    rows = files.text_documents(spark, str(folder / "in")).collect()
    got = {r.title: r for r in rows}
    assert len(rows) == 3 and got["Memo One"].text == TEXTS["memo-one.md"] and set(got) == {"Finance Report", "Memo One", "Notice"} and got["Notice"].doc_id.startswith("txt-")


def test_end_to_end_ingest(spark, folder):
    docs = files.text_documents(spark, str(folder / "in"))
    tables = ingest.derived_tables(docs)
    kinds = {r.pattern_type for r in tables["pii"].collect()}
    assert kinds == {"email", "phone", "ssn", "dob", "address"}
    store.write_store(tables, str(folder / "store"), cluster_by={"postings": ["term", "doc_id"]})
    back = records.read_store(spark, str(folder / "store"), "pages")
    assert back.count() == 3 and back.schema == schemas.STORE["pages"]
    assert spark.read.parquet(str(folder / "store" / "postings")).filter("term = 'wire'").count() == 1


def test_records_nested_bare_and_corrupt(spark, tmp_path):
    nested = {"source_path": "/a.pdf", "document": {"id": "d1", "title": "One", "tags": ["x", "y"], "ocrText": "t"},
              "pages": [{"document_id": "d1", "page_number": 1, "text_content": "t", "char_count": 1}]}
    bare = {"id": "d2", "title": "Two", "pdfUrl": "http://u"}
    for name, body in {"a.json": json.dumps(nested, indent=1), "b.json": json.dumps(bare), "c.json": "{broken"}.items():
        (tmp_path / name).write_text(body)
    recs = records.read_records(spark, str(tmp_path)).cache()
    got = {r.doc_id: r for r in records.record_documents(recs).collect()}
    assert set(got) == {"d1", "d2"} and got["d1"].file_path == "/a.pdf" and got["d2"].file_path == "http://u" and got["d1"].tags == "x; y"
    assert [tuple(r) for r in records.record_pages(recs).collect()] == [("d1", 1, "t", 1)]
    assert recs.filter("_corrupt_record IS NOT NULL").count() == 1


def test_registry_file(spark, tmp_path):
    people = [{"id": "p1", "slug": "a", "name": "Ann", "aliases": ["A."], "category": "k", "shortBio": "b"}, {"id": "p2", "slug": "b", "name": "ann"}]
    (tmp_path / "r.json").write_text(json.dumps(people))
    from foliolake.operators.entities import registry_names

    got = {r.name_key: r.person_id for r in registry_names(records.read_registry(spark, str(tmp_path / "r.json"))).collect()}
    assert got == {"ann": "p2", "a.": "p1"}


def test_vectors_with_wrong_length_are_dropped(spark):
    rows = [(1, 2, bytearray(struct.pack("<2f", 0.5, -1))), (2, 3, bytearray(struct.pack("<2f", 1, 2))), (3, 1, bytearray(b"abc")), (4, 1, None)]
    got = vectors.decode_vectors(spark.createDataFrame(rows, "id int, dims int, embedding binary")).collect()
    assert [(r.id, list(r.embedding)) for r in got] == [(1, [0.5, -1.0])]


def test_keep_one_of_equal_arrivals(spark):
    df = spark.createDataFrame([(1, v, 5) for v in "abcdef"], "k int, v string, seq int")
    picked = {store.keep_one(df.repartition(n, "v"), ["k"], "seq", policy="replace").first().v for n in (1, 3, 5)}
    assert len(picked) == 1


def test_keep_one_policies(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, seq int, v string")
    for policy, want in (("replace", {"a": "y", "b": "z"}), ("ignore", {"a": "x", "b": "z"})):
        assert {r.k: r.v for r in store.keep_one(df, ["k"], "seq", policy=policy).collect()} == want


def test_ad_hoc_sql_is_read_only(spark):
    df = spark.range(100)
    assert records.sql(spark, "SELECT id FROM t WHERE id >= :a ORDER BY id;", {"t": df}, page_size=5, offset=1, args={"a": 90}).count() == 5
    with pytest.raises(ValueError):
        records.sql(spark, "DROP TABLE t", {"t": df})
    for text in ("FROM t INSERT INTO u SELECT *", "WITH x AS (SELECT 1 AS id) INSERT INTO u SELECT * FROM x",
                 "WITH x AS (SELECT 1 AS id) DELETE FROM u", "SET a = 1", "CREATE VIEW v AS SELECT 1", "INSERT INTO u VALUES (1)"):
        with pytest.raises((ValueError, ParseException)):
            records.sql(spark, text, {"t": df})
    assert records.sql(spark, "WITH x AS (SELECT id FROM t) SELECT * FROM x UNION ALL VALUES (7)", {"t": df}).count() == 50
    assert len(records.run_limited(df.limit(3), 60)) == 3


def test_ledger(spark):
    schema = "file_hash string, stage string, result_path string, completed_at double"
    led = spark.createDataFrame([("a", "ocr", "1", 1.0), ("b", "ocr", "2", 1.0)], schema)
    led = ledger.mark(led, spark.createDataFrame([("a", "ocr", "9", 2.0), ("a", "dedup", "3", 2.0)], schema))
    assert ledger.is_processed(led, "a", "ocr").collect()[0].result_path == "9"
    inputs = spark.createDataFrame([("a",), ("c",), ("c",)], "file_hash string")
    assert [r[0] for r in ledger.unprocessed(inputs, led, "ocr").collect()] == ["c", "c"]
    assert {r.stage: r.n for r in ledger.stage_counts(ledger.clear_stage(led, "ocr")).collect()} == {"dedup": 1}


def test_stream_picks_up_later_arrivals(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    batches = [[(1, "first text"), (2, "mail x@y.org")], [(3, "third\n\nparagraph")]]
    schema = "doc_id long, text string"
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        stream = ingest.arriving(spark, src, spark.createDataFrame([], schema).schema)
        ingest.ingest_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    every = spark.createDataFrame(sum(batches, []), schema)
    for name, want in ingest.derived_tables(every).items():
        cols = [c for c in want.columns if c != "person_id"]
        got = spark.read.parquet(f"{out}/{name}").select(*cols)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*cols).collect())), name


def test_image_rules(spark):
    rows = [(1, 100, 100, 9000, 300.0, 300.0), (2, 10, 100, 9000, 300.0, 300.0), (3, 100, 100, 10, 300.0, 300.0), (4, 290, 290, 9000, 300.0, 300.0), (5, 290, 290, 9000, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, width int, height int, size_bytes int, page_width double, page_height double")
    assert {r.id for r in stats.keep_images(df).collect()} == {1, 5}
    assert stats.image_tallies(df).collect()[0].asDict() == {"new": 2, "skipped_small": 2, "skipped_pagescan": 1}


def test_name_variants_and_checkpoint(spark):
    df = spark.createDataFrame([("Trump", 9), ("Donald Trump", 8), ("Ann Lee", 7), ("Lee", 6), ("Bo", 5)], "name string, n long")
    assert [r.name for r in cut_lineage(stats.drop_name_variants(df)).collect()] == ["Trump", "Ann Lee", "Bo"]


def test_image_stub_and_sort_orders(spark):
    df = spark.createDataFrame([("/x/my_pic.PNG", bytearray(b"12")), ("/x/a.txt", bytearray(b"1"))], "path string, content binary")
    row = files.image_stubs(df).collect()[0]
    assert (row.title, row.text, row.char_count) == ("my pic", "[Image file: my_pic.PNG]", len("my_pic.PNG") + 14)
    from foliolake.operators.browse import sort_documents

    d = spark.createDataFrame([(1, "2020", "b"), (2, None, "a"), (3, "2021", "c")], "doc_id int, date string, title string")
    for key, want in (("date_desc", [3, 1, 2]), ("date_asc", [1, 3, 2]), ("title", [2, 1, 3])):
        assert [r.doc_id for r in d.orderBy(*sort_documents(d, key)).collect()] == want
    assert d.select(F.count("*")).collect()[0][0] == 3


def test_registry_keeps_the_order_of_the_file(spark, tmp_path):
    people = [{"id": str(n), "slug": f"p{n}", "name": f"Person {n % 50}", "aliases": [], "category": "x", "shortBio": "s" * 400} for n in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(people))
    (tmp_path / "b.json").write_text(json.dumps([{**people[0], "id": "late"}]))
    (tmp_path / "c.json").write_text("no list")
    got = records.read_registry(spark, str(tmp_path)).repartition(7).orderBy("ord").collect()
    assert [r.person_id for r in got] == [p["id"] for p in people] + ["late"]
