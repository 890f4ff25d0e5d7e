"""Headline queries on one machine, the median of three runs in random order; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import random
import statistics
import sys
import time

from keepsake.plans import REGISTRY, Tables
from keepsake.session import local_session

HEADLINE = (
    "hybrid_search", "hybrid_search_batch", "keyword_topk", "vector_topk", "build_links", "links_read",
    "detect_events", "detect_settle", "series_percentiles", "ad_segments", "merge_segments", "chunk_text",
    "interval_overlap", "asof_settle", "list_items", "timeline", "item_with_chunks", "route_decision",
    "category_dedupe", "context_assembly", "search_context", "integrity_report",
)

REPEATS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "keepsake-bench")
    tables = Tables(spark, folder)
    REGISTRY["store_stats"].build(tables).collect()        # read footers
    spark.range(64).repartition(8).mapInArrow(lambda batches: batches, "id long").collect()    # start workers
    runs: dict[str, list[float]] = {name: [] for name in names}
    for turn in range(REPEATS):
        for name in random.Random(turn).sample(names, len(names)):
            start = time.perf_counter()
            REGISTRY[name].build(tables).write.format("noop").mode("overwrite").save()
            runs[name].append(round(time.perf_counter() - start, 3))
            print(turn, name, runs[name][-1], file=sys.stderr, flush=True)
    took = {name: statistics.median(x) for name, x in runs.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")),
                      "first_run": {name: x[0] for name, x in runs.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
