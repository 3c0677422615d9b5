"""The stages together."""

import importlib

from foliolake.llm import toxicity

from .conftest import SF

pipeline = importlib.import_module("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "language_id", "simhash_dedup", "secret_scan", "packing"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
            assert {r["doc_id"] for r in out.collect()} == {k for k, s in scores.items() if s < 0.7}
        if name != "packing":
            assert out.columns == columns
        assert out.count() <= seen
        docs, seen = out, out.count()
    assert docs.columns == ["doc_id", "n_tokens", "bucket", "padded_tokens", "batch", "slot"]
    assert pipeline.run(spark, SF).count() == seen
