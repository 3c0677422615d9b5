"""A unit that several rows give counts once per term; all its rows count in ``tf``."""

import duckdb

from foliolake import plans
from foliolake.operators import search

from .oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_rows_of_one_unit_count_once(spark):
    rows = [("a", "1", "x y x"), ("a", "1", "x z"), ("a", "1", None), ("a", "2", "x"), ("a", None, "x w"), ("a", None, "w"), ("b", "1", "x"), ("b", "2", "X")]
    units = spark.createDataFrame(rows, "g string, u string, t string")
    got = search.term_counts(units, "g", "u", "t", search.repeated_units(units, "g", "u"))
    want = {("a", "x", 5, 2), ("a", "y", 1, 1), ("a", "z", 1, 1), ("a", "w", 2, 0), ("b", "x", 2, 2)}
    assert sorted(map(tuple, got.select("g", "term", "tf", "df").collect())) == sorted(want)


def test_four_corpora_with_repeated_and_null_keys(spark, tmp_path):
    con = duckdb.connect()
    for name in TABLES:
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "conversations":  # the same turn again, and turns without a number
            t = t.unionByName(t.limit(20)).unionByName(t.limit(5).selectExpr("conv_id", "CAST(NULL AS BIGINT) AS turn", "role", "text"))
        if name == "documents":  # an id with two texts
            t = t.unionByName(t.filter("doc_id % 7 = 0").selectExpr("doc_id - 1 AS doc_id", "text", "lang", "source", "n_chars"))
        t.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = plans.queries()["index_four_corpora"](spark, str(tmp_path))
    assert compare(got, con, plans.oracle_sql()["index_four_corpora"]) is None
