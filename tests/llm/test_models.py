"""Trained operators by held-out accuracy, and their limits."""

import zlib

from pyspark.sql import functions as F

from foliolake.llm import language, stages, toxicity

from .conftest import AWKWARD

SF = "/root/testdata/sf0.01"


def held_out(key):
    return zlib.crc32(str(key).encode()) % 3 == 1


def test_toxicity_held_out(spark):
    from foliolake.llm.queries import queries
    got = {r["doc_id"]: r for r in queries()["op7_toxicity"](spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == held_out(k) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for k, r in got.items())
    test = [(got[k]["predicted"], y) for k, y in labels.items() if held_out(k) and k in got]
    assert sum(p for p, y in test if y) >= 0.6 * sum(y for _, y in test)
    assert sum(p for p, y in test if not y) <= 0.01 * len(test)


def test_toxicity_points_at_sentences():
    rows = [("plain words here\nmore plain words", 0)] * 30 + [("plain words here\nyou are a nitwit indeed", 1)] * 30
    scorer = toxicity.fit(rows, 300).scorer()
    text = "Plain words here. You are a nitwit indeed! More plain words."
    assert scorer.score(text) > 0.7 > 0.3 > scorer.score("Plain words here. More plain words.")
    worst = max(scorer.sentences(text), key=lambda s: s[2])
    assert "nitwit" in text[worst[0]:worst[1]] and worst[2] > 0.5


def test_toxicity_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (9, 0)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    rows = toxicity.score_documents(awkward, model).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert toxicity.score_documents(awkward.limit(0), model).count() == 0
    assert toxicity.train(awkward.limit(0), labels.limit(0)).weights == {}
    toxic = toxicity.Model({"plain": 20.0}, -5.0)
    spans = {r["doc_id"]: r["sentences"] for r in toxicity.offending_sentences(awkward, toxic).collect()}
    assert set(spans) == {1, 9} and [(s["start"], s["end"]) for s in spans[9]] == [(0, 26)]
    assert stages.without_toxic(awkward, labels).columns == awkward.columns


def test_scores_do_not_see_labels_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, changed)


def test_language_held_out(spark):
    from foliolake.llm.queries import queries
    got = {r["doc_id"]: r for r in queries()["op10_language"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    test = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in rows if held_out(r["doc_id"])]
    assert sum(a == b for a, b in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_kernel_counts_common_grams():
    grams = language.Grams(list("abc"))
    model = language.Model(["x"], list("abc"), [grams.of("abc")])
    value = language.Scorer(model).kernel(["abcb"])[0, 0]
    count = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    want = len(count("abc") & count("abcb")) / (len(count("abc")) * len(count("abcb"))) ** 0.5
    assert abs(value - want) < 1e-6


def test_language_awkward_rows(spark, awkward):
    model = language.train(awkward)
    rows = language.predict(awkward, model).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4, 5)} == {"und"}
    assert language.predict(awkward.limit(0), language.train(awkward.limit(0))).count() == 0
    kept = stages.with_language(awkward)
    assert kept.columns == awkward.columns and {2, 3, 4, 5}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_language_stage_decides_by_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    strange = {-1: "съешь же ещё этих мягких французских булок да выпей чаю " * 3, -2: "αυτό είναι ένα κείμενο στα ελληνικά " * 5,
               -3: "这是一个用中文写的句子" * 10, -4: "qzxj vkwq zzxk jqvx wkqz xjzv qkxw vzqj " * 4, -5: "12 34"}
    both = docs.unionByName(spark.createDataFrame([(k, t, None) for k, t in strange.items()], docs.schema))
    kept = {r["doc_id"] for r in stages.with_language(both).collect()}
    clean = {r["doc_id"] for r in docs.where(r"text rlike '\\p{L}'").collect() if held_out(r["doc_id"])}
    assert kept.isdisjoint(strange)
    assert len(clean) > 300 and clean <= kept


def test_language_stage_without_a_model_keeps_letters(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (None, "слова", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = docs.withColumn("lang", F.lit("en")).withColumn("doc_id", F.lit(None).cast("long"))
    fold_one = next(k for k in range(100) if held_out(k))
    held = docs.withColumn("lang", F.lit("en")).withColumn("doc_id", F.lit(fold_one).cast("long"))
    for df in (docs, labelled, held):
        assert {r["text"] for r in stages.with_language(df).collect()} == {"some words", "слова"}
