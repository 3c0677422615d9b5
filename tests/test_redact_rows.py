"""Personal data found and cut within the row: the same pages as by joins, no exchange; cheap patterns rule out no match."""

import pytest
from pyspark.sql import functions as F

from foliolake.operators import pii

TEXTS = ["SSN 123-45-6789 and call (212) 555-0147, +1 212.555.0148 now", "Born on 3/12/1975; age: May 4, 1980", "a@b.org x@y.co.uk, 12 Old Mill Road and 9 Kay Street ", "",
         None, "no data 12 here", "٢١٢ ٥٥٥ ٠١٤٧ and 555-12-3456", "12 Old Mill Road 7 éa Été St", "born Été 3 2001, 1-2-99 born", "212-555-0147212-555-0147 1234567890", "é3/4/1999 birthday 5 Kſt Rd."]


@pytest.mark.parametrize("ascii_words", [True, False])
def test_needs_rule_out_no_match(spark, monkeypatch, ascii_words):
    pages = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text_content string").withColumn("page_number", F.lit(1))
    found = sorted(map(tuple, pii.scan_pii(pages, ascii_words=ascii_words).collect()))
    monkeypatch.setattr(pii, "NEEDS", {})
    assert found == sorted(map(tuple, pii.scan_pii(pages, ascii_words=ascii_words).collect())) and len(found) > 8


@pytest.mark.parametrize("ascii_words", [True, False])
def test_redacted_in_the_row(spark, ascii_words):
    pages = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text_content string").withColumn("page_number", F.lit(1))
    cols = ["doc_id", "page_number", "text_content", "char_count", "redacted"]
    got = pii.redact_found(pages, ascii_words=ascii_words).select(*cols)
    want = pii.redact(pages, pii.scan_pii(pages, ascii_words=ascii_words)).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
