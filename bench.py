"""Times the headline queries: one JSON line with the total and the seconds of each query.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run once to warm up and then BENCH_RUNS times (default 2); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from panelforge.plans import catalog
from panelforge.session import get_spark

HEADLINE = (
    "drift_top_features w3_rolling_moments w4_w6_typed_lag_diff w5_causal_past_mean_median w19_rank_vs_train_reference f3_quantile_buckets e1_winsorise "
    "a9_correlation_matrix x1_time_aware_folds d1_ks_per_feature d4_psi d5_wasserstein d12_tp_fp_separation r1_build_metrics r8_roc_auc m4_oof_assembly "
    "m18_policy_benchmark g13_validation_gates e8_self_excluded_neighbours e13_layout_neighbours m1_raw_baseline_oof m7_adversarial_auc"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = sys.argv[1:] or HEADLINE
    spark = get_spark("bench")
    times: dict[str, float] = {}
    for name in wanted:
        build = catalog.load()[name].build
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:] or took), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
