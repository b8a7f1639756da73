"""Headline-query benchmark.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each headline query once on a fresh local session (after one small warm-up query),
executing the full plan into Spark's ``noop`` sink (no collection to the driver), and
prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "split_pipeline",       # cutoffs, catalog join, partitioned zstd write, counts
    "clean_ratings",        # null filter + keep-last per (user, movie)
    "serving_catalog",      # unique movies, overview join, search text, counts
    "search_movies",        # substring search, ranked top-20 per query
    "recommend",            # flagship: scores, pool, top-k, explanations, cohort notes
    "diversity_rerank",     # greedy diverse top-k per profile
    "cohort_counts",        # fans and their high ratings per profile
    "taste_summary",        # persona, DNA, written profile
    "feedback_state",       # vote fold per (session, movie)
    "payload_parse",        # JSON metadata ingest
    "content_vectors",      # genre vocabulary, year z-score, L2 vectors
    "baseline_mean",        # clean splits, train universe, metrics
]


def main() -> None:
    from reelspark.plans.registry import REGISTRY, load_all
    from reelspark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    load_all()
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    # warm-up: JVM, Python workers and parquet footers (not timed)
    REGISTRY["title_year"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    from reelspark.functions import memo

    for name in HEADLINE:
        memo.clear()              # each query pays for its own stages and statistics
        fn = REGISTRY[name][0]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
