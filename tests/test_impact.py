"""The stored index against a search of the text itself."""

import random

import pytest
from pyspark.sql import functions as F

from foliolake.operators import impact, search, unified

WORDS = ["ash", "bee", "cat", "dog", "elm", "ant", "asp"]


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(5)
    rows = []
    for n in range(400):
        text = " ".join(rng.choices(WORDS, weights=[60, 25, 8, 4, 2, 1, 1], k=rng.choice([0, 1, 3, 9, 40, 200])))
        rows.append((rng.choice(["page", "image"]), rng.choice(["a", "b", "c"]), n // 3, n % 3, text))
    rows.append(("page", "empty", 900, 0, None))
    return spark.createDataFrame(rows, "corpus string, dataset string, doc_id int, page_number int, text string")


@pytest.fixture(scope="module")
def index(spark, units, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    impact.write_index(units, ["doc_id", "page_number"], "text", folder, buckets=5, bits=2)
    return impact.open_index(spark, folder, ["doc_id", "page_number"], buckets=5)


def rows(df):
    return {(r["doc_id"], r["page_number"]): round(r["rank"], 9) for r in df.collect()}


@pytest.mark.parametrize("terms,mode", [(["ash"], "all"), (["ash", "elm"], "all"), (["cat", "dog", "bee"], "all"), (["elm", "ant"], "any"),
                                        (["a*"], "all"), (["as*", "bee"], "all"), (["as*", "elm"], "any"), (["zzz"], "all"), (["ash", "zzz"], "all")])
def test_find_equals_the_text_search(units, index, terms, mode):
    for corpus in ("page", "image"):
        want = rows(search.search_text(units.filter(F.col("corpus") == corpus), "text", terms, mode=mode))
        assert rows(impact.find(index, terms, mode=mode, where=F.col("corpus") == corpus)) == want


def test_counts_within_a_data_set(units, index):
    got = impact.find(index, ["ash", "cat"], by=["dataset"], where=F.col("corpus") == "page")
    for dataset in "abc":
        own = units.filter((F.col("corpus") == "page") & (F.col("dataset") == dataset))
        assert rows(got.filter(F.col("dataset") == dataset)) == rows(search.search_text(own, "text", ["ash", "cat"]))


@pytest.mark.parametrize("by", [["corpus"], ["dataset"]])
def test_best_equals_the_head_of_all(index, by):
    for k, terms in ((1, ["ash"]), (3, ["dog", "bee", "ash"]), (50, ["elm", "ash"]), (3, ["ash", "zzz"])):
        every = impact.find(index, terms, by=by).collect()
        want = set()
        for key in {tuple(r[c] for c in by) for r in every}:
            own = sorted((round(r["rank"], 9), r["doc_id"], r["page_number"]) for r in every if tuple(r[c] for c in by) == key)
            want |= {(key, *o[1:], n) for n, o in enumerate(own[:k], 1)}
        got = {(tuple(r[c] for c in by), r["doc_id"], r["page_number"], r["position"]) for r in impact.best(index, terms, k, by=by).collect()}
        assert got == want, (k, terms)


def test_best_reads_few_blocks(spark, tmp_path_factory):
    # one unit in a thousand is far better than the rest: the other blocks of a common term stay unread
    units = spark.range(20_000).select(F.lit("page").alias("corpus"), F.lit("").alias("dataset"), F.col("id").alias("doc_id"), F.lit(1).alias("page_number"),
                                       F.when(F.col("id") % 1000 == 0, "ash " * 50).otherwise(F.concat(F.lit("ash "), F.repeat(F.lit("bee "), 50))).alias("text"))
    folder = str(tmp_path_factory.mktemp("blocks"))
    impact.write_index(units, ["doc_id", "page_number"], "text", folder, bits=4)
    ix = impact.open_index(spark, folder, ["doc_id", "page_number"])
    got = impact.best(ix, ["ash"], 5)
    assert {r["doc_id"] % 1000 for r in got.collect()} == {0}
    assert ix.blocks.filter("term = 'ash'").count() > 1000
    assert ix.blocks.filter("term = 'ash' and top_tf > 1").count() < 20


def test_no_job_before_the_plan_and_no_length_table(index):
    plan = impact.find(index, ["ash", "elm"], where=F.col("corpus") == "page")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "Scan parquet" in line and "n_tokens" in line and "term" in line]
    assert scans and all("PartitionFilters: [term_bucket" in s or "term_bucket#" in s.split("PartitionFilters: [", 1)[1].split("]")[0] for s in scans)


def test_prefixes_have_no_block_bounds(index):
    with pytest.raises(ValueError):
        impact.best(index, ["as*"], 3)


def test_boolean_search_with_a_prefix_reads_its_buckets(index, units):
    got = {tuple(r) for r in search.match_units(index.postings, index.unit, all_of=["bee"], none_of=["dog"], prefix=["as"], terms=index.vocabulary, buckets=5).collect()}
    tokens = {(r.doc_id, r.page_number): set((r.text or "").split()) for r in units.collect()}
    assert got == {u for u, t in tokens.items() if "bee" in t and "dog" not in t and t & {"ash", "asp"}}


def test_typed_search(units, index):
    dates = units.select("doc_id").distinct().select("doc_id", F.lit("t").alias("title"), F.when(F.col("doc_id") < 50, "2001-01-01").otherwise("2002-01-01").alias("date"))
    every = impact.find(index, ["bee"]).collect()
    inside = sorted((round(r["rank"], 9), r["corpus"], r["doc_id"], r["page_number"]) for r in every if r["corpus"] != "page" or r["doc_id"] < 50)
    got = unified.typed_search(index, ["bee"], documents=dates, date_to="2001-12-31", offset=2, limit=7).collect()
    cut = [o for kind in ("image", "page") for o in [x for x in inside if x[1] == kind][2:9]]
    assert [(r.type, r.document_id, r.page_number) for r in sorted(got, key=lambda r: (round(r["rank"], 9), r.type, r.document_id, r.page_number))] == [o[1:] for o in sorted(cut)[:7]]
    assert {r.total for r in got} == {len(inside)}
    assert {r.type: r.total for r in unified.typed_totals(index, ["zzz"]).collect()} == {"page": 0, "image": 0}
