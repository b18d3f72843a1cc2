"""Headline-query benchmark: prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default HEADLINE).
Each query runs to completion through the no-op sink (full execution, nothing
collected to the driver); wall seconds per query.  Before timing, every headline query
runs once on the smallest scale (BENCH_WARMUP_DIR, default /root/testdata/sf0.001) so JIT
and code generation are warm; the timed runs then execute fully at BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "complete_input",             # catalog -> prompts (joins, windows, ordered aggregation)
    "render_training_record",     # dedupe, split, dictionary extraction over whole documents
    "parse_training_record",      # record file write + custom-separator read + regex parse
    "kfold_extraction_quality",   # spans, fold-aware dictionary, range join, metrics, mean/std
    "evaluate_candidates",        # char n-gram BLEU/GLEU + readability per candidate
    "evaluate_candidates_clean",  # + cleaning chain with near-duplicate Arrow UDF
    "storyboard",                 # review parsing, token-cosine alignment, captions
    "align_features",             # dense-vector cosine join
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    from prodtext.plans import QUERIES
    from prodtext.session import get_spark

    spark = get_spark("prodtext-bench", cpus, shuffle_partitions=int(cpus) * 2)
    # warm-up: JVM JIT, code generation, Python workers (small scale, not timed)
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": cpus, "spark": spark.version}))


if __name__ == "__main__":
    main()
