"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. A few queries run first to warm
the JVM up, then every query runs once untimed and ``BENCH_RUNS`` times (default 3); the median counts.
Results are written to the no-op sink, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairset.plans import catalogue  # noqa: E402
from pairset.session import local_session  # noqa: E402

HEADLINE = [
    "cascade_ledger", "cascade_survivors", "missing_stats", "split_train_val", "keyword_family", "fabric_family",
    "quantile_bucket", "target_shares", "metric_by_axes", "metric_mean_std", "run_totals", "paired_diff",
    "pivot_modes", "rolling_mean_100", "running_best", "step_time_eta", "microbatch_mean", "log_parse",
    "log_summary", "top_k_per_group", "label_shares", "overlap_suppression", "image_stats", "pair_scores",
    "stratified_subset", "diverse_subset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "pairset-bench")
    known = catalogue.queries()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    timings: dict[str, float] = {}
    for name in names[:3]:
        known[name](spark, sf_dir).collect()
    for name in names:
        samples = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(samples[1:]), 4)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 4), "unit": "sec",
        "queries": timings, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        "cpus": os.environ.get("BENCH_CPUS", "8"), "runs": runs, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
