"""Pairs of links are made in a number of tasks that grows with the links, and stay whole."""

import itertools
from collections import Counter

from foliolake.operators import graph


def test_pairs_are_dealt_to_more_tasks_as_links_grow(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_LINKS", 5)
    rows = [(g, p) for g in range(40) for p in {g % 7, g % 5, 20 + g % 3}] + [(99, p) for p in range(30)]
    edges = graph.cooccurrence(spark.createDataFrame(rows, "doc_id long, person_id long"), "doc_id", "person_id")
    least = 1 + len(set(rows)) // 5
    assert least > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f"REPARTITION_BY_NUM" in (plan := edges._jdf.queryExecution().executedPlan().toString()) and f", {least})" in plan
    want = Counter(pair for g in {g for g, _ in rows} for pair in itertools.combinations(sorted({p for h, p in rows if h == g}), 2))
    assert {(r["source"], r["target"]): r["weight"] for r in edges.collect()} == want
