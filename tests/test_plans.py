"""Plan rules that must hold for every named query."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# these run a stream or write first; their result is a plain scan
EAGER = {n for n in entry.queries() if n.startswith("stream_") or n.endswith("_round_trip")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - EAGER))
def test_no_nested_loops(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # a window without partition columns would be one task
    assert not re.search(r"windowspecdefinition\((?:\w+#\d+L? (?:ASC|DESC))", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["date_range_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    plan = plan_of(entry.queries()["content_hash"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_row_limits_come_before_the_shuffle(spark):
    for name in ("best_sources", "first_occurrences", "project_entities", "evidence_cap", "vector_topk"):
        assert "WindowGroupLimit" in plan_of(entry.queries()[name](spark, SF)), name


def test_top_lists_do_not_sort_everything(spark):
    for name in ("ranked_search", "paging", "entity_directory_page", "project_entities"):
        assert "TakeOrderedAndProject" in plan_of(entry.queries()[name](spark, SF)), name


def test_stored_postings_are_pruned(spark):
    plan = plan_of(entry.queries()["ranked_search_index"](spark, SF))
    scans = [line for line in plan.split("\n") if "Scan parquet" in line and "term_bucket" in line]
    assert scans and all("PartitionFilters: [term_bucket" in line or "term_bucket#" in line.split("PartitionFilters: [", 1)[1].split("]")[0] for line in scans)


def test_evidence_reads_few_tables(spark):
    plan = plan_of(entry.queries()["evidence_tables"](spark, SF))
    assert "term_bucket" not in plan and plan.count("Scan parquet") <= 24


def test_tables_in_buckets_join_without_an_exchange(spark):
    plan = plan_of(entry.queries()["store_buckets"](spark, SF))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert plan.count("SelectedBucketsCount: 16 out of 16") == 2
