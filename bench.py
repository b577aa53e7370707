"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bazaarflow.plans.bindings import QUERIES  # noqa: E402
from bazaarflow.session import local_session  # noqa: E402

HEADLINE = [
    "jn2_ladder_topk", "sim11_best_match", "jn4_approximate_topk", "jn5_best_supplier", "sim12_structured_match",
    "jn6_trigram_pairs", "geo1_resolve", "geo2_text_mention", "cls12_normalise", "cls1_activity", "cls4_service_type",
    "txt1_page_text", "txt5_clean_description", "web1_supplier_signals", "web13_qualified_leads", "num4_process_price",
    "agg4_price_ladder", "agg7_zone_pivot", "agg9_source_summary", "jn13_export_queue", "jn14_flatten_catalogue",
    "set1_batch_dedup", "set2_merge_suppliers", "snk1_upsert", "upd1_apply_updates", "top4_first_by_position",
    "str1_incremental_run",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    timings: dict[str, float] = {}
    for name in names:
        taken = []
        for turn in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if turn:
                taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(folder.rstrip("/")), "cores": cores, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
