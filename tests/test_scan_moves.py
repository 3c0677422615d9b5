"""A scan for names reads a text once, moves none while names are few, and finds what ``contains`` finds."""

import random

import pytest

from foliolake.operators import name_scan


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(11)
    words = ["Anna", "ion", "IO", "é", "𝄞x", "the of", "blue ring", "ringing", "\n", "Öl", "motion picture", " "]
    texts = ["".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 40]))) for _ in range(150)] + [None, "", "x", "th", "the o", "f the"]
    names = sorted({t.lower()[a:a + n] for t in texts if t for a, n in [(rng.randrange(len(t)), rng.choice([3, 4, 7, 8, 9, 15]))]} | {"ion", "the of", "no such name", "ab"})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    registry = spark.createDataFrame([(n, f"p{i}") for i, n in enumerate(names)], "name_key string, person_id string")
    want = {(d, f"p{i}") for d, t in enumerate(texts) if t for i, n in enumerate(names) if len(n) >= 3 and n in t.lower()}
    return docs, registry, want


@pytest.mark.parametrize("few,letters", [(100_000, 1_000_000), (0, 50)])
def test_scan_finds_what_contains_finds(made, monkeypatch, few, letters):
    docs, registry, want = made
    monkeypatch.setattr(name_scan, "FEW_PIECES", few)
    monkeypatch.setattr(name_scan, "SCAN_CHARS", letters)
    got = [(r["doc_id"], r["person_id"]) for r in name_scan.scan_names(docs, registry).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 100


def test_scan_moves_no_text(spark, made):
    docs, registry, _ = made
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = name_scan.scan_names(docs, registry)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(doc_id" not in plan and "_low" in plan


@pytest.mark.parametrize("name", ["direct_scan", "document_person_sets"])
def test_queries_make_no_row_per_gram(spark, name):
    from foliolake import plans

    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(_low" not in plan and "MapInArrow" in plan
