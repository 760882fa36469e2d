"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. Every result is
computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from stratalens.plans import QUERIES
from stratalens.session import get_session

HEADLINE = [
    "collect_results", "extract_scores", "score_extract", "score_search", "metrics_long",
    "metrics_wide", "merge_chunks", "t1_coverage", "t2_layer_coverage", "t3_slices",
    "t4_arm_summary", "t5_layer_profile", "t6_best_layer", "t7_trend_wide", "t8_sensitivity",
    "t9_win_rate", "task_table_wide", "avg_main_extremes", "task_type_stats", "compare_summary",
    "metrics_describe", "top_extremes", "resume_pending", "task_bucket", "chunk_assign", "corpus",
    "corpus_records", "embed_corpus", "pool_mean", "l2_normalize", "effective_rank", "anisotropy",
    "prompt_entropy", "dataset_entropy", "mean_pairwise_cosine", "knn_join", "curvature",
    "repr_metrics", "score_sts", "score_pair_ap", "score_rerank_map", "score_centroid_acc",
    "task_reward", "linucb_state", "linucb_score", "trajectory", "bandit_replay",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in sys.argv[1:] if n in QUERIES] or HEADLINE
    for name in ("t1_coverage", "embed_corpus"):  # start the JVM's and Python's workers
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
