"""Search, context, caps, fusion, history and personal data on small stores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliolake.functions import fixed_values as V
from foliolake.operators import pii, questions, retrieval, search, unified, vectors

PAGES = [
    (1, 1, "The bank sent a wire transfer to the fund. " * 3), (1, 2, "Second page speaks of travel, not money."),
    (2, 1, "Prison memo: staff met at noon. Wire fraud was discussed."), (2, 2, "Mailed the memo; transfer of staff."), (2, 3, "Wire, wire and transfer."),
    (3, 4, "Résumé of the fund's bank accounts."), (3, 6, "Nothing here"),
]
UNIT = ["doc_id", "page_number"]


def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id int, page_number int, text_content string")


def docs(spark):
    return spark.createDataFrame([(1, "Ledger", "2019-01-01"), (2, "Memo", "2020-01-01"), (3, "EFTA00000003", None)], "doc_id int, title string, date string").withColumn(
        "date", F.try_to_date("date"))


def bm25(terms):
    import re

    toks = {(d, p): re.findall(r"[^\W_]+", t.lower().replace("é", "e")) for d, p, t in PAGES}
    mean = sum(map(len, toks.values())) / len(toks)
    out = {}
    for unit, tk in toks.items():
        if all(t in tk for t in terms):
            score = 0.0
            for t in terms:
                n = sum(t in x for x in toks.values())
                idf = max(math.log((len(toks) - n + 0.5) / (n + 0.5)), 1e-6)
                tf = tk.count(t)
                score -= idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tk) / mean))
            out[unit] = round(score, 9)
    return out


@pytest.mark.parametrize("terms", [["wire"], ["wire", "transfer"], ["Résumé"], ["missing", "wire"], ["fund", "bank", "the"]])
def test_both_search_paths_agree_with_formula(spark, terms):
    want = bm25([t.lower().replace("é", "e") for t in terms])
    direct = search.search_text(pages(spark), "text_content", terms)
    assert {(r.doc_id, r.page_number): round(r["rank"], 9) for r in direct.collect()} == want
    postings, doclens = search.build_index(pages(spark), UNIT, "text_content")
    qt = search.query_terms(spark.createDataFrame([(7, " ".join(terms))], "query_id int, q string"), "q", ["query_id"])
    indexed = search.search(postings, doclens, qt, UNIT)
    assert {(r.doc_id, r.page_number): round(r["rank"], 9) for r in indexed.collect()} == want


def test_empty_query_finds_nothing(spark):
    assert search.search_text(pages(spark), "text_content", ["?!"]).count() == 0


def test_boolean_predicates(spark):
    postings, _ = search.build_index(pages(spark), UNIT, "text_content")

    def got(**spec):
        return {tuple(r) for r in search.match_units(postings, UNIT, **spec).collect()}

    assert got(phrase=["wire", "transfer"]) == {(1, 1)}
    assert got(phrase=["wire", "and", "transfer"]) == {(2, 3)}
    assert got(all_of=["wire"], none_of=["fraud"]) == {(1, 1), (2, 3)}
    assert got(prefix=["discuss"]) == {(2, 1)} and got(any_of=["travel", "nothing"]) == {(1, 2), (3, 6)}


def test_refresh_index_touches_changed_units_only(spark):
    postings, _ = search.build_index(pages(spark), UNIT, "text_content")
    changed = spark.createDataFrame([(1, 2, "brand new words")], "doc_id int, page_number int, text_content string")
    removed = spark.createDataFrame([(3, 6)], "doc_id int, page_number int")
    fresh = search.refresh_index(postings, changed, removed, UNIT, "text_content")
    after = pages(spark).join(removed, UNIT, "left_anti").join(changed.select(*UNIT), UNIT, "left_anti").unionByName(changed)
    want, _ = search.build_index(after, UNIT, "text_content")
    key = ["term", *UNIT, "tf"]
    assert sorted(map(tuple, fresh.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_snippet_slides_to_densest_window(spark):
    text = "a wire b c d e f wire transfer g h i"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(search.snippet("t", ["wire", "transfer"], words=4)).collect()[0][0] == "...**wire** **transfer** g h..."
    assert df.select(search.snippet("t", F.array(F.lit("wire"), F.lit("transfer")), words=4)).collect()[0][0] == "...**wire** **transfer** g h..."
    assert df.select(search.snippet("t", ["zzz"], words=3)).collect()[0][0] == "a wire b..."
    assert df.select(search.snippet("t", ["wir*"], words=50)).collect()[0][0].count("**") == 4


def test_match_window(spark):
    text = "h" * 1500 + "needle in the stack" + "t" * 3000
    df = spark.createDataFrame([(text, "...**needle** in the stack"), (text, ""), ("short", "x"), (text, "absent")], "t string, s string")
    got = [r[0] for r in df.select(search.match_window("t", "s")).collect()]
    assert got == [text[:250] + "\n...\n" + text[1200:3200], text[:2000], "short", text[:2000]]


def test_adjacent_context_skips_missing_pages(spark):
    hits = spark.createDataFrame([(2, 2, "x"), (3, 4, "y"), (3, 6, "z")], "doc_id int, page_number int, text string")
    got = {(r.doc_id, r.page_number): r.text for r in retrieval.with_adjacent(hits, pages(spark), chars=10).collect()}
    assert got == {(2, 2): "[...]discussed.\nx\nWire, wire[...]", (3, 4): "y", (3, 6): "z"}


def test_siblings_only_for_small_documents(spark):
    many = spark.createDataFrame([(9, i, f"p{i}") for i in range(1, 8)], "doc_id int, page_number int, text_content string")
    store = pages(spark).unionByName(many)
    hits = spark.createDataFrame([(1, 2, 3, 1), (1, 9, 4, 2)], "question_id int, doc_id int, page_number int, ordinal int")
    got = retrieval.number_results(retrieval.with_siblings(hits, store, query=["question_id"]), total=50)
    rows = [(r.doc_id, r.page_number, r.ordinal) for r in got.orderBy("ordinal").collect()]
    assert rows == [(2, 3, 1), (9, 4, 2), (2, 1, 3), (2, 2, 4)]


def test_named_documents_and_overview(spark):
    q = spark.createDataFrame([(1, "what is in efta00000003 and EFTA00000003?"), (2, "no id; eml-0123abcd"), (3, "XEFTA00000003")], "question_id int, question string")
    named = retrieval.named_documents(q)
    assert {tuple(r) for r in named.collect()} == {(1, "EFTA00000003"), (2, "eml-0123abcd")}
    seen = spark.createDataFrame([(1, 3, 4)], "question_id int, doc_id int, page_number int")
    got = retrieval.overview_pages(named, docs(spark), pages(spark), seen).collect()
    assert [(r.question_id, r.doc_id, r.page_number, r.snippet) for r in got] == [(1, 3, 6, "Nothing here")]


@pytest.mark.parametrize("layout, kept", [
    ([(1, 15), (2, 1)], 16), ([(1, 12)], 12), ([(1, 17), (2, 1)], 18), ([(1, 15), (2, 8)], 8), ([(1, 10), (2, 10)], 8), ([(1, 7), (2, 3)], 10),
])
def test_evidence_cap(spark, layout, kept):
    rows, n = [], 0
    for doc, count in layout:
        for page in range(count):
            n += 1
            rows.append((1, doc, page, n))
    df = spark.createDataFrame(rows, "question_id int, doc_id int, page_number int, ordinal int")
    got = retrieval.cap_per_document(df).collect()
    assert len(got) == kept
    for doc, count in layout:
        if count / n < 0.7:
            assert sorted(r.page_number for r in got if r.doc_id == doc) == list(range(min(4, count)))


def test_best_sources_first_hit_wins(spark):
    rows = [(1, 5, 89, 1), (1, 5, 4, 2), (1, 5, 42, 3)] + [(1, 100 + i, 1, 10 + i) for i in range(25)]
    got = retrieval.best_sources(spark.createDataFrame(rows, "question_id int, doc_id int, page_number int, ordinal int"))
    rows = sorted((r.source_no, r.doc_id, r.page_number) for r in got.collect())
    assert len(rows) == 15 and rows[0] == (1, 5, 89)


def test_fusion(spark):
    def ranked(units):
        return spark.createDataFrame([(d, p, i + 1) for i, (d, p) in enumerate(units)] or [], "doc_id int, page_number int, rank_no int")

    def fused(a, b):
        return [(r.doc_id, r.page_number) for r in retrieval.fuse(ranked(a), ranked(b)).orderBy("ordinal").collect()]

    assert fused([(1, 1), (2, 1)], [(2, 1), (3, 1)]) == [(2, 1), (1, 1), (3, 1)]
    assert fused([(1, 1), (2, 1)], []) == [(1, 1), (2, 1)] and fused([], [(3, 1)]) == [(3, 1)] and fused([], []) == []
    assert fused([(1, 1)], [(2, 1)]) == [(1, 1), (2, 1)]


def test_first_occurrence_keeps_first_query(spark):
    rows = [(1, 0, 1, 1, 2), (1, 1, 1, 1, 1), (1, 1, 2, 1, 2), (1, 0, 3, 1, 1)]
    df = spark.createDataFrame(rows, "question_id int, query_no int, doc_id int, page_number int, position int")
    got = [(r.doc_id, r.query_no) for r in retrieval.first_occurrences(df, total=2).orderBy("ordinal").collect()]
    assert got == [(3, 0), (1, 0)]


def test_history(spark):
    msgs = [(1, t, "user" if t % 2 == 0 else "assistant", f"{'q' if t % 2 == 0 else 'a'}{t} " * (1 if t else 200)) for t in range(20)]
    msgs += [(2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 10, "user", "x"), (3, 30, "user", "y"), (3, 40, "assistant", "z" * 700)]
    msgs += [(3, 50 + i, "user", "tail") for i in range(12)]
    df = spark.createDataFrame(msgs, "conv_id int, turn int, role string, text string")
    lines = retrieval.history_lines(df)
    text = {r.conv_id: r.history for r in retrieval.history_text(lines).collect()}
    q0 = ("q0 " * 200)[:150].strip()
    want1 = V.HISTORY_HEADER + "\n" + "\n".join(f"Q: {q0 if t == 0 else f'q{t}'}\nA: a{t + 1}\n" for t in range(0, 8, 2))
    assert text == {1: want1, 3: V.HISTORY_HEADER + "\n" + f"Q: y\nA: {'z' * 600}...\n"}
    context = retrieval.prompt_context(df)
    assert context.filter("conv_id = 2").count() == 2 and context.filter("conv_id = 1 AND part = 3").count() == 12


def test_question_flow_end_to_end(spark):
    postings, doclens = search.build_index(pages(spark), UNIT, "text_content")
    qt = spark.createDataFrame([(1, 0, "wire"), (1, 0, "transfer"), (1, 1, "resume"), (2, 0, "absent")], "question_id int, query_no int, term string")
    hits = questions.find_pages(postings, doclens, qt)
    full = questions.full_results(hits, qt, pages(spark), docs(spark))
    rows = full.orderBy("ordinal").collect()
    assert {(r.doc_id, r.page_number) for r in rows if r.band == 0} == {(1, 1), (2, 3), (3, 4)}
    assert {(r.doc_id, r.page_number) for r in rows if r.band == 1} == {(1, 2), (2, 1), (2, 2), (3, 6)}
    assert all("**" in r.snippet for r in rows if r.band == 0)
    evidence = retrieval.evidence_text(retrieval.cap_per_document(full)).collect()[0]
    assert evidence.evidence.startswith("### ") and evidence.n_pages == 7
    asked = spark.createDataFrame([(1,), (2,)], "question_id int")
    tried = qt.groupBy("question_id").agg(F.countDistinct("query_no").alias("n_queries"))
    rep = {r.question_id: r for r in retrieval.answer_report(asked, full, docs(spark).agg(F.count("*")), tried).collect()}
    assert rep[1].found and rep[2].report == "Searched 3 documents using 1 query"


def test_unified_and_dated_search(spark):
    part = pages(spark).select(F.col("doc_id").alias("document_id"), "page_number", F.col("text_content").alias("text"))
    got = unified.unified_search({"page": part, "image": part.limit(0)}, ["wire"], limit=2).collect()
    assert len(got) == 2 and {r.type for r in got} == {"page"}
    assert {r.type: r.total for r in unified.match_totals({"page": part}, ["wire"]).collect()} == {"page": 3}
    dated = unified.dated_search(pages(spark), docs(spark), ["wire"], date_from="2019-06-01").collect()
    assert {r.doc_id for r in dated} == {2}


def test_hybrid_results(spark):
    from foliolake.operators import questions

    text = spark.createDataFrame([(1, 10, 1, 1, "window of ten", "snip ten", "Ten", 0), (1, 11, 1, 2, "window of eleven", "snip eleven", "Eleven", 0),
                                  (2, 11, 1, 1, "only text", "snip", "Eleven", 0)],
                                 "question_id int, doc_id int, page_number int, ordinal int, text string, snippet string, title string, band int")
    near = spark.createDataFrame([(1, 11, 1, 1), (1, 12, 1, 2)], "question_id int, doc_id int, page_number int, rank_no int")
    every = spark.createDataFrame([(d, 1, f"bare page of {d}") for d in (10, 11, 12, 13)], "doc_id int, page_number int, text_content string")
    docs = spark.createDataFrame([(d, f"T{d}") for d in (10, 11, 12, 13)], "doc_id int, title string")
    front = spark.createDataFrame([(1, 13, 1, "T13", "opening", "open"), (1, 10, 1, "T10", "known already", "x")],
                                  "question_id int, doc_id int, page_number int, title string, text string, snippet string")
    rows = questions.hybrid_results(text, near, every, docs, overview=front).orderBy("question_id", "ordinal").collect()
    got = [(r["question_id"], r["ordinal"], r["doc_id"], r["text"], r["snippet"], r["title"]) for r in rows]
    assert got == [
        (1, 1, 13, "opening", "open", "T13"),  # overview first, less what was found anyway
        (1, 2, 11, "window of eleven", "snip eleven", "Eleven"),  # in both lists: the text list's words
        (1, 3, 10, "window of ten", "snip ten", "Ten"),
        (1, 4, 12, "bare page of 12", "bare page of 12", "T12"),  # vectors alone
        (2, 1, 11, "only text", "snip", "Eleven"),  # no vector hits: the text list as it is
    ]


def test_vector_topk_equals_brute_force(spark):
    rng = random.Random(3)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    vecs = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in vecs]
    qs = vecs[:4]
    df = spark.createDataFrame(vecs, "vec_id int, embedding array<double>")
    q = spark.createDataFrame(qs, "query_id int, embedding array<double>")
    got = {(r.query_id, r.rank_no): r.vec_id for r in vectors.vector_topk(q, df, k=5, min_similarity=0.2).collect()}
    want = {}
    for qid, qv in qs:
        sims = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in vecs))
        want |= {(qid, n + 1): i for n, (s, i) in enumerate(sims[:5]) if -s >= 0.2}
    assert got == want
    for tile in (1, 2, 100):
        tiled = vectors.vector_topk(q, df, k=5, min_similarity=0.2, query_slice=3, tile_queries=tile)
        assert {(r.query_id, r.rank_no): r.vec_id for r in tiled.collect()} == want
    assert vectors.vector_topk(q.limit(0), df).count() == 0
    assert vectors.vector_topk(q, df.limit(0), query_slice=0).count() == 0


def test_vector_topk_reads_the_vectors_once(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.cos(F.col("id") * i) / 2).cast("array<float>").alias("embedding")).write.parquet(f"{tmp_path}/v")
    v = spark.read.parquet(f"{tmp_path}/v")
    q = v.filter("vec_id < 300").withColumnRenamed("vec_id", "query_id")
    few, tiled = vectors.vector_topk(q, v, k=7), vectors.vector_topk(q, v, k=7, query_slice=50, tile_queries=64)

    def rows(df):
        return {(r.query_id, r.rank_no): round(r.similarity, 9) for r in df.collect()}

    assert rows(few) == rows(tiled) and len(rows(few)) == 2100
    plan = tiled._jdf.queryExecution().optimizedPlan().toString()
    # one scan of the queries, one of the vectors
    assert plan.count("parquet") == 2 and "Join" not in plan


@pytest.mark.parametrize("slice_", [0, 10])
def test_vector_topk_with_very_many_ties_and_nulls(spark, monkeypatch, slice_):
    monkeypatch.setattr(vectors, "_CELLS", 64)
    same = spark.range(500).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("vec_id"),
                                   F.when(F.col("id") == 400, F.array(F.lit(2.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    v = same.unionByName(spark.createDataFrame([("a", None)], "vec_id string, embedding array<double>"))
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", None), (None, [0.5, 0.5])], "query_id string, embedding array<double>")
    got = vectors.vector_topk(q, v, k=3, query_slice=slice_, tile_queries=2).collect()
    want = {(n, i): (s, v) for n, f in (("x", 1.0), (None, 0.5)) for i, (s, v) in enumerate([(2 * f, "v0400"), (f, "v0000"), (f, "v0001")], 1)}
    assert {(r.query_id, r.rank_no): (r.similarity, r.vec_id) for r in got} == want


def test_best_gives_ties_instead_of_holding_them():
    import numpy as np
    import pyarrow as pa

    best = vectors._Best(pa.array([7]), np.array([[1.0]]), 2, 0.25, ["q", "key", "similarity"])
    best.limit = 10
    given = []
    for at in range(0, 100, 5):
        given += best.show(pa.table({"key": list(range(at, at + 5))}), np.full((5, 1), 0.5))
        assert best.rows <= 15
    given += best.show(pa.table({"key": [100]}), np.array([[0.9]]))
    given += best.give()
    rows = [r for b in given for r in b.to_pylist()]
    assert {r["key"] for r in rows} == set(range(101)) and {r["q"] for r in rows} == {7}


def test_embedding_jobs(spark):
    enc = vectors.hashing_encoder(16)
    made = vectors.embed_pages(pages(spark), enc)
    assert made.count() == 6  # one page is too short
    norms = made.select(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).collect()
    assert all(abs(r[0] - 1) < 1e-5 for r in norms)
    assert vectors.embed_pages(pages(spark), enc, made).count() == 0 and vectors.embed_pages(pages(spark), enc, made, overwrite=True).count() == 6


# --- personal data ----------------------------------------------------------------------------

CASES = [
    ("call (212) 555-0147 now", [("phone", "212) 555-0147")]), ("dial 333-333-3333", []), ("seq 234-567-8901", []), ("see https://a.b/212-555-0101", []),
    ("AB123456 then 415-555-0199", []), ("mail a.b@c.org!", [("email", "a.b@c.org")]), ("id 123-45-6789", [("ssn", "123-45-6789")]), ("000-12-3456", []),
    ("666-12-3456", []), ("912-34-5678", []), ("123-00-4567", []), ("123-45-0000", []), ("ABC12345 " + "x" * 60 + " 123-45-6789", [("ssn", "123-45-6789")]),
    ("born 3/4/1975", [("dob", "3/4/1975")]), ("dated 3/4/1975", []), ("this page is of March 3, 1999", [("dob", "March 3, 1999")]),
    ("lives at 12 old mill road today", [("address", "12 old mill road")]), ("", []),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_pii_cases(spark, i):
    text, want = CASES[i]
    df = spark.createDataFrame([(1, 1, text)], "doc_id int, page_number int, text_content string")
    got = pii.scan_pii(df).orderBy("start").collect()
    assert [(r.pattern_type, r.match_text) for r in got] == want
    assert all(text[r.start:r.end] == r.match_text for r in got)


def test_redaction_removes_the_union_of_spans(spark):
    rng, texts, spans = random.Random(9), [], []
    for p in range(40):
        t = "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 60)))
        texts.append((1, p, t))
        for _ in range(rng.randint(0, 4)):
            s = rng.randint(0, len(t) - 1)
            spans.append((1, p, s, min(len(t), s + rng.randint(1, 12))))
    spans.append((99, 1, 0, 5))
    df = spark.createDataFrame(texts, "doc_id int, page_number int, text_content string")
    m = spark.createDataFrame(spans, "doc_id int, page_number int, start int, end int")
    got = {r.page_number: r for r in pii.redact(df, m).collect()}
    rough = {r.page_number: r.text_content for r in pii.redact(df, m, exact_overlap=True).collect()}
    for _, p, t in texts:
        mine = [(s, e) for _, q, s, e in spans if q == p and _ == 1]
        gone = {i for s, e in mine for i in range(s, e)}
        assert got[p].text_content == "".join(c for i, c in enumerate(t) if i not in gone)
        assert got[p].char_count == len(got[p].text_content) and got[p].redacted == len(mine)
        step = t
        for s, e in sorted(mine, reverse=True):
            step = step[:s] + step[e:]
        assert rough[p] == step


def test_redacted_index(spark):
    df = spark.createDataFrame([(1, 1, "mail a@b.org here"), (1, 2, "clean page")], "doc_id int, page_number int, text_content string")
    postings, _ = search.build_index(df, UNIT, "text_content")
    done = pii.redact(df, pii.scan_pii(df))
    terms = {r.term for r in pii.redact_index(postings, done).collect()}
    assert terms == {"mail", "here", "clean", "page"}
    assert pii.pii_summary(pii.scan_pii(df)).collect()[0].asDict() == {"match_count": 1, "affected_pages": 1}


def test_snippet_of_very_many_hits(spark):
    import time

    text = "word " * 100_000 + "other " * 10
    df = spark.createDataFrame([(text,)], "t string")
    begin = time.time()
    got = df.select(search.snippet("t", ["word"], words=8).alias("s")).collect()[0][0]
    assert got == " ".join(["**word**"] * 8) + "..." and time.time() - begin < 60


def test_snippet_equals_plain_search_for_the_densest_window(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["hit", "a", "b", "c"][: rng.choice([2, 4])]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for words in (1, 5, 16):
        for i, got in df.select("i", search.snippet("t", ["hit"], words=words)).collect():
            ws = texts[i].split()
            starts = [n for n, w in enumerate(ws) if w == "hit"]
            best = max(starts, key=lambda n: (sum(n <= q < n + words for q in starts), -n), default=0)
            at = max(min(best, len(ws) - words), 0)
            shown = " ".join(f"**{w}**" if w == "hit" else w for w in ws[at:at + words])
            assert got == ("..." if at else "") + shown + ("..." if at + words < len(ws) else "")
