"""The repair reads a text once: its costly parts stand once in the expression."""

from pyspark.sql import functions as F

from foliolake.functions import repair


def test_costly_parts_stand_once(spark):
    df = spark.createDataFrame([("cafÃ©",), ("plain",), ("é",), ("",), (None,), ("Ã©\n",), ("日本",)], "t string")
    out = df.select(repair.fix_mojibake("t").alias("t"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") == 1 and plan.count("RLIKE") == 1
    assert [r[0] for r in out.collect()] == ["café", "plain", "é", "", None, "é\n", "日本"]
