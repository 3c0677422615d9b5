"""The index is written where units are read: no posting moves."""

from pyspark.sql import functions as F

from foliolake.operators import impact, search


def test_postings_stay_with_their_units(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(impact, "TASK_UNITS", 1)
    rows = [("page", "d", i, 1, f"the word w{i % 5} the end") for i in range(40)]
    units = spark.createDataFrame(rows, "corpus string, dataset string, doc_id long, page_number int, text string").repartition(4, "doc_id")
    home = {r[0]: r[1] for r in units.select("doc_id", F.spark_partition_id()).collect()}
    unit = ["doc_id", "page_number"]
    impact.write_index(units, unit, "text", f"{tmp_path}/ix", buckets=2)
    ix = impact.open_index(spark, f"{tmp_path}/ix", unit, buckets=2)
    files = {}
    for r in ix.postings.select(F.input_file_name().alias("f"), "doc_id").collect():
        files.setdefault(r["f"], set()).add(home[r["doc_id"]])
    assert all(len(homes) == 1 for homes in files.values())
    got = {(r["doc_id"], round(r["rank"], 9)) for r in impact.find(ix, ["the", "w3"]).collect()}
    assert got == {(r["doc_id"], round(r["rank"], 9)) for r in search.search_text(units, "text", ["the", "w3"]).collect()} and len(got) == 8
    best = [r["doc_id"] for r in impact.best(ix, ["the", "w3"], 3).orderBy("position").collect()]
    assert best == sorted(d for d, _ in got)[:3]
    assert sorted(map(tuple, ix.postings.select("term", "doc_id", "tf", "positions", "n_tokens").collect())) == sorted(
        (*r, 5) for r in map(tuple, search.build_index(units, unit, "text")[0].select("term", "doc_id", "tf", "positions").collect()))


def test_postings_of_text_are_cut_in_their_row(spark, tmp_path):
    """``index_postings`` moved every posting once; a unit's tokens are all in one row."""
    from foliolake import plans

    spark.createDataFrame([(1, "a b a", "en", "x")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    scan = spark.conf.get("spark.foliolake.scanPartitions", None)
    spark.conf.unset("spark.foliolake.scanPartitions")
    try:
        got = plans.queries()["index_postings"](spark, str(tmp_path))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.select("term", "tf", "positions").collect())) == [("a", 2, "0 2"), ("b", 1, "1")]
    finally:
        if scan:
            spark.conf.set("spark.foliolake.scanPartitions", scan)
