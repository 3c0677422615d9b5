"""The ad-hoc query counts what its SQL counts: rows of no length, too, and rows of no language."""

import duckdb

from foliolake import plans

from .oracle import compare


def test_ad_hoc_sql_counts_every_row(spark, tmp_path):
    rows = [(1, "", "en", "x", 0), (2, None, "en", "x", None), (3, "a", "de", "x", 1), (4, "b", None, "x", 1), (5, "c", "fr", "x", 1), (6, "d", "es", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = plans.queries()["ad_hoc_sql"](spark, str(tmp_path))
    assert compare(got, con, plans.oracle_sql()["ad_hoc_sql"]) is None
