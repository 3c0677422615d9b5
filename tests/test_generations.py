"""Stores in segments against a dictionary that is overwritten batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from foliolake.operators import search
from foliolake.sources import generations as g
from foliolake.streaming import ingest

SCHEMA = "doc_id long, arrived long, gone boolean, text string"


def lines():
    return {
        "lines": lambda t: t["sent"].select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "word")),
        "counts": lambda t: t["lines"].groupBy("doc_id").agg(F.count("*").alias("words")),
    }


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, store):
    words, counts = {}, {}
    for r in g.live(spark, store, "lines").collect():
        words.setdefault(r.doc_id, {})[r.n] = r.word
    for r in g.live(spark, store, "counts").collect():
        assert r.doc_id not in counts
        counts[r.doc_id] = r.words
    texts = {d: " ".join(w[i] for i in range(len(w))) for d, w in words.items()}
    assert counts == {d: len(t.split(" ")) for d, t in texts.items()}
    return texts


def test_replacing_deleting_and_compacting(spark, tmp_path):
    rng, want, fan = random.Random(2), {}, 2
    store = g.Store(str(tmp_path), cluster_by={"lines": ["doc_id", "n"]})
    for n in range(5):
        rows = [(d, 0, rng.random() < 0.25, " ".join(rng.choices("abc", k=rng.randint(1, 4)))) for d in rng.sample(range(12), 5)]
        g.write(spark, store, n, batch(spark, rows), lines(), deleted="gone")
        for d, _, gone, text in rows:
            want.pop(d, None)
            if not gone:
                want[d] = text
        assert held(spark, store) == want
        while run := g.due(g.spans(spark, store), fan):
            g.compact(spark, store, *run)
        assert held(spark, store) == want
    assert len(g.spans(spark, store)) < 5


def test_a_generation_written_again_replaces_itself(spark, tmp_path):
    store = g.Store(str(tmp_path))
    g.write(spark, store, 0, batch(spark, [(1, 0, False, "a b"), (2, 0, None, "c")]), lines(), deleted="gone")
    for _ in range(2):
        g.write(spark, store, 1, batch(spark, [(1, 0, False, "d"), (None, 0, False, "no key")]), lines(), deleted="gone")
    assert held(spark, store) == {1: "d", 2: "c"}


def test_nothing_shows_before_the_segment_is_complete(spark, tmp_path):
    store = g.Store(str(tmp_path))
    g.write(spark, store, 0, batch(spark, [(1, 0, False, "a")]), lines())

    def lost(t):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        g.write(spark, store, 1, batch(spark, [(1, 0, False, "b"), (2, 0, False, "b")]), lines() | {"more": lost})
    assert held(spark, store) == {1: "a"}
    g.write(spark, store, 1, batch(spark, [(1, 0, False, "b"), (2, 0, False, "b")]), lines())
    assert held(spark, store) == {1: "b", 2: "b"}


def test_empty_batches_and_stores(spark, tmp_path):
    store = g.Store(str(tmp_path), partition_by={"lines": "word"})
    with pytest.raises(ValueError):
        g.live(spark, store, "lines")
    g.write(spark, store, 0, batch(spark, []), lines(), deleted="gone")
    assert held(spark, store) == {}
    g.write(spark, store, 1, batch(spark, [(1, 0, False, "a b")]), lines(), deleted="gone")
    g.write(spark, store, 2, batch(spark, [(1, 0, True, None)]), lines(), deleted="gone")
    assert held(spark, store) == {}
    g.compact(spark, store, 0, 2)
    assert held(spark, store) == {} and g.spans(spark, store) == [(0, 2)]
    with pytest.raises(ValueError):
        g.compact(spark, store, 0, 1)


def test_due():
    assert g.due([]) is None and g.due([(0, 0)], 2) is None
    assert g.due([(0, 0), (1, 1)], 2) == (0, 1)
    assert g.due([(0, 3), (4, 4), (5, 5), (6, 6)], 4) is None
    assert g.due([(0, 3), (4, 4), (5, 5), (6, 6), (7, 7)], 4) == (4, 7)
    assert g.due([(0, 3), (4, 7), (8, 11), (12, 15)], 4) == (0, 15)


def test_documents_that_come_again_leave_one_set(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), ingest.case_store(str(tmp_path / "store"))
    sends = [
        [(1, 1, False, "Call 555-123-4567 for John Smith\n\nold second page"), (2, 1, False, "apple banana")],
        [(1, 2, False, "apple"), (1, 3, False, "cherry apple"), (3, 1, False, "banana")],
        [(2, 9, True, None), (3, None, False, "late"), (3, 1, False, "plum")],
    ]
    for rows in sends:
        batch(spark, rows).coalesce(1).write.mode("append").parquet(inbox)
        ingest.replacing_stream(ingest.arriving(spark, inbox, batch(spark, []).schema), store, str(tmp_path / "check"), order="arrived",
                                deleted="gone", fan=2).awaitTermination()
    assert {(r.doc_id, r.page_number, r.text_content) for r in g.live(spark, store, "pages").collect()} == {(1, 1, "cherry apple"), (3, 1, "plum")}
    assert g.live(spark, store, "pii").count() == 0 and g.live(spark, store, "entities").count() == 0
    postings = g.live(spark, store, "postings")
    assert {(r.term, r.doc_id) for r in postings.collect()} == {("cherry", 1), ("apple", 1), ("plum", 3)}
    terms = spark.createDataFrame([("apple",)], "term string")
    assert [r.doc_id for r in search.only_terms(postings, terms).filter("term = 'apple'").collect()] == [1]
    assert {r.doc_id: r.n_tokens for r in g.live(spark, store, "doclens").collect()} == {1: 2, 3: 1}
    assert sorted(r.doc_id for r in g.live(spark, store, "hashes").collect()) == [1, 3]


def test_row_postings_equal_the_index(spark):
    rng = random.Random(9)
    rows = [(n // 2, n % 2, " ".join(rng.choices(["ash", "Ash", "bee", "Élan", "x-y", "..."], k=rng.randint(0, 12)))) for n in range(60)]
    units = spark.createDataFrame([*rows, (90, 0, None), (91, 0, ""), (92, 0, "one"), (93, 0, "z " * 300)], "doc_id int, page_number int, text string")

    def found(df):
        return sorted((r.term, r.doc_id, r.page_number, r.tf, tuple(r.positions)) for r in df.collect())

    fast, unit = search.row_postings(units, ["doc_id", "page_number"], "text"), ["doc_id", "page_number"]
    want = search.build_index(units, unit, "text")[0]
    assert found(fast) == found(want) and fast.dtypes == want.dtypes
    assert "Exchange" not in fast._jdf.queryExecution().executedPlan().toString()


def test_postings_of_a_stream_do_not_move(spark, tmp_path, monkeypatch):
    from foliolake.streaming import ingest

    store = ingest.case_store(str(tmp_path))
    plans = []
    plain = g._put
    monkeypatch.setattr(g, "_put", lambda s, st, name, df, span, **more: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())),
                                                                          plain(s, st, name, df, span, **more))[1])
    made = ingest.replaceable_tables(separator="\n")
    docs = spark.createDataFrame([(i, f"w{i % 3} and the w{i} the") for i in range(12)], "doc_id long, text string").repartition(3)
    homes = {}
    g.write(spark, store, 0, docs, {name: made[name] for name in ("pages", "postings")})
    assert [name for name, plan in plans if "Exchange" in plan and name == "postings"] == []
    files = spark.read.parquet(f"{tmp_path}/postings").selectExpr("input_file_name() as f", "term", "doc_id").collect()
    # a file is what one task wrote: documents of different tasks never share one
    for r in spark.read.parquet(f"{tmp_path}/pages").selectExpr("input_file_name() as f", "doc_id").collect():
        homes[r["doc_id"]] = r["f"]
    met = {}
    for r in files:
        met.setdefault(r["f"], set()).add(homes[r["doc_id"]])
    got = {(r["term"], r["doc_id"], r["tf"]) for r in g.live(spark, store, "postings").collect()}
    assert got == {(t, i, f"w{i % 3} and the w{i} the".split().count(t)) for i in range(12) for t in f"w{i % 3} and the w{i} the".split()}
    assert len({f.rsplit("part-", 1)[1].split("-")[0] for f in met}) > 1
