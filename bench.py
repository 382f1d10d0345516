"""Benchmark the headline queries.

Runs each headline query at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]``: one warm-up, then the
median of ``$BENCH_REPS`` (default 3) timed runs of build + execute
(``collect``).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m14_segmented_mae",      # flagship: split, grouped OLS x2, metrics, pairs, CI + t-test
    "v4_regression_pairs",    # grouped OLS for all datasets in one aggregate
    "m12_paired_r2",          # paired t + Wilcoxon, refined by metadata
    "m16_drivers_table",      # fan-out join, Welch + Mann-Whitney
    "m5_structural_sensitivity",
    "e10_box_stats",
    "l9_breusch_pagan",
    "i12_distance_similarity",
    "k11_auc",
    "e3_summarize_ci",
    "l7_wilcoxon",
]

#: Iterative and model queries, timed once without warm-up under "slow" (not in the headline total).
SLOW = ["i3_kmeans", "j8_smote", "k4_gradient_boost", "k14_inverse_fit"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    from vantage import get_session
    from vantage.plans.catalog import QUERIES, load_all

    load_all()
    spark = get_session(f"local[{cpus}]", app="vantage-bench")
    names = [n for n in HEADLINE if n in QUERIES]
    times: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        fn(spark, sf_dir).collect()  # warm-up
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn(spark, sf_dir).collect()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    slow: dict[str, float] = {}
    for name in (n for n in SLOW if n in QUERIES):
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        slow[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "slow": slow, "sf": sf, "cpus": int(cpus), "reps": reps}))


if __name__ == "__main__":
    main()
