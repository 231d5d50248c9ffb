"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import REGISTERED  # noqa: E402
from lakesearch.session import local_session  # noqa: E402

HEADLINE = [
    "q_topk_batch",
    "q_topk_grouped",
    "q_topk_passes",
    "q_topk_whole_ranking",
    "q_hits_join_docs",
    "q_positions",
    "q_append_positions",
    "q_source_files",
    "q_doc_segments",
    "q_page_elements",
    "q_py_chunks",
    "q_brace_chunks",
    "q_code_positions",
    "q_hash_embed",
    "q_term_statistics",
    "q_hash_search",
    "q_rerank",
    "q_search_e2e",
    "q_index_summary",
    "q_workload",
    "q_latency_summary",
    "q_latency_overall",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rsplit("/sf", 1)[-1],
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
