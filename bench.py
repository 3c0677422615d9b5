"""Times the headline queries (the best of BENCH_RUNS runs each); prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

from foliolake import plans
from foliolake.plans.bindings import case_store
from foliolake.session import local_session

HEADLINE = [
    "page_pack", "chunk_boundaries", "content_hash", "html_documents", "segment_page_numbers", "index_postings", "ranked_search",
    "ranked_search_index", "boolean_search", "question_pages", "evidence_tables", "federated_search", "vector_topk", "rank_fusion",
    "pii_scan", "pii_redact", "regex_entities", "direct_scan", "link_persons", "duplicate_hashes", "range_overlap_links",
    "range_overlap_counts", "title_links", "document_graph", "mention_graph", "entity_directory", "project_entities", "history_lines",
    "ledger_upsert", "adjacent_context",
]
ASK_THE_STORE = ["ranked_search_index", "boolean_search", "question_pages", "evidence_tables"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus))
    queries = plans.queries()
    names = list(queries) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    # one small query starts the executors, the code generator and the parquet reader
    queries["sample_titles"](spark, sf).collect()
    times: dict[str, float] = {}
    if any(n in names for n in ASK_THE_STORE):
        # pages, postings and vocabulary are built once; the searches below run on the finished store
        begin = time.perf_counter()
        case_store(spark, sf)
        times["store_build"] = round(time.perf_counter() - begin, 3)
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            begin = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        times[name] = round(min(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(os.path.normpath(sf))}))


if __name__ == "__main__":
    main()
