import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: Nulls, empty texts, ties, repeated rows and columns whose names an operator might use itself.
AWKWARD = [
    (1, "Some plain words of a text. And another sentence here!", "en"),
    (1, "Some plain words of a text. And another sentence here!", "en"),
    (2, "", "en"), (3, None, None), (None, "no id but words are here", "de"), (None, None, None),
    (4, " \t\n ", None), (5, "12 34² -- ½", "en"), (6, "é中文😀 ñ " * 40, "es"), (7, "x" * 70_000, "en"),
    (8, "word " * 30_000, "en"), (9, "Some plain words of a text. And another sentence here!", "en"), (10, "a", "fr"),
]
CLASH = ["n_tokens", "score", "held_out", "fp", "sketch", "component", "_size", "_shard", "_slot", "_hash", "_tie", "media", "base", "added",
         "n_bytes", "bucket", "batch", "_at__rank", "u", "v", "y", "k", "t", "h", "id", "n_chars"]


@pytest.fixture(scope="session")
def awkward(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           *[T.StructField(c, T.StringType()) for c in CLASH]])
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in AWKWARD], schema)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
