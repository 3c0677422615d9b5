"""The SQL twins on rows that the driver tables lack: keys without a pattern, and close vectors."""

import random

import duckdb
import numpy as np

from foliolake.llm import secrets
from foliolake.llm.queries import oracle_sql, queries

from ..oracle import compare
from .test_layout import TRICKY


def test_secrets(spark, tmp_path):
    draw = random.Random(9)
    key = lambda kind, n: "".join(draw.choice(secrets.ALPHABETS[kind]) for _ in range(n))
    texts = [*TRICKY, "", "plain"]
    for i in range(150):
        kinds = [draw.choice(list(secrets.ALPHABETS)) for _ in range(draw.randint(0, 4))]
        words = ["usr/local/share/python/site-packages", "token: " + key("hex", 12), "InternationalizationOfNames2024", "é"]
        texts.append(" ".join(draw.sample([*[key(k, draw.randint(18, 60)) + "=" * (i % 3) for k in kinds], *words], k=len(kinds) + 4)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries()["op1_secrets"](spark, str(tmp_path))
    assert compare(found, con, oracle_sql()["op1_secrets"]) is None
    assert found.selectExpr("sum(n_random)").first()[0] > 50


def test_vectors(spark, tmp_path):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((20, 32))
    rows = [(i, [float(x) for x in (base[i % 20] + draw.standard_normal(32) * (0.2 if i % 4 else 0)).astype(np.float32)], i % 2) for i in range(200)]
    rows += [(500, None, 1), (501, [0.0] * 32, 0), (502, rows[0][1], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = queries()["op2_vector_dedup"](spark, str(tmp_path))
    assert found.where("n_links > 0").count() > 50
    assert compare(found, con, oracle_sql()["op2_vector_dedup"]) is None
