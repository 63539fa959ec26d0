"""Time the headline queries. Prints one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tidemark.queries import QUERIES
from tidemark.session import local_session

HEADLINE = [
    "p1_step", "p8_interval_label", "p10_standardised", "m1_m6_events_multiclass", "m7_m8_m9_orders", "m7_m8_m9_lineitem",
    "k1_last_class", "k2_majority_class", "k3_naive_bayes", "k4_logistic_block", "k5_knn", "k11_hoeffding_tree",
    "k14_adaptive_random_forest", "k15_mondrian_forest", "e1_online_bagging", "e3_leveraging_bagging", "e6_voting",
    "e8_exponential_weights", "r1_mean", "r2_fading_mean", "r4_linear_fleet", "r4_normal_equations", "r7_hoeffding_tree_regressor",
    "r15_gradient_boosted_regression", "n1_gaussian_scorer", "n4_half_space_trees", "n6_isolation_forest", "n10_anomaly_checkpoints",
    "a1_final_metrics", "c1_comparison", "c8_heat_map", "c11_best_regression",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session("tidemark-bench", cpus, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM, the Python workers and the scan path before the clock runs
    spark.range(1000).repartition(8).groupBy().count().collect()
    spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    spark.range(8).mapInPandas(lambda it: it, "id long").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
