"""Benchmark the headline queries.

Runs each query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and forces full evaluation through the ``noop`` sink
(nothing is collected to the driver).  Prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_and_standardize",
    "unique_unigrams",
    "word_frequency",
    "pos_tag",
    "feature_table",
    "trial_summary",
    "homogenization_rougel",
    "ngram_diversity",
    "compression_ratio",
    "common_patterns",
    "treekernel_summary",
    "bertscore_summary",
    "report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    only = [a for a in sys.argv[1:]]
    from varietas.session import ensure_checkpoint_dir, get_spark
    from varietas.plans.queries import QUERIES

    spark = get_spark(master=f"local[{cpus}]", app="varietas-bench",
                      shuffle_partitions=max(8, 2 * cpus))
    ensure_checkpoint_dir(spark)
    # warm-up: JVM, Python workers, parquet footers
    QUERIES["total_instructions"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only or HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
