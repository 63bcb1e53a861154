"""Time the second run of each headline query and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local threads,
BENCH_QUERIES (comma-separated prefixes, or 'all') another choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumenpair.plans import catalog, fixtures
from lumenpair.plans.registry import Tables
from lumenpair.session import build_session

HEADLINE = [
    "a1_summary_by_category",
    "a1_summary_lineitem_scale",
    "a3_summary_by_benchmark",
    "a6_margin_summary",
    "a8_j8_model_leaderboard",
    "a11_margin_histogram",
    "a13_perf_event_rollup",
    "d1_feature_statistics",
    "d2_effective_rank_spectrum",
    "d6_positive_negative_logits",
    "f2_relabel_success_filter",
    "f4_clean_sentence",
    "f6_split_sentences",
    "f11_crop_box",
    "j1_relabel_fallback",
    "j2_ordered_path_resolution",
    "j5_all_pairs_similarity",
    "j6_identical_file_match",
    "n1_word_order_negatives",
    "n2_random_negatives",
    "q1_benchmark_verifier",
    "r3_recall_metrics",
    "r5_u3_bidirectional_top_k",
    "r6_prune_then_rescore",
    "r6_conditioned_full_report",
    "s1_subcaption_sampling",
    "s3_balanced_category_limit",
    "s5_epoch_shuffle",
    "src3_src4_tar_shard_scan",
    "src5_keyed_record_scan",
    "src10_word_order_pairs",
    "st1_running_accuracy",
    "v3_pairwise_margins",
    "v6_encode_texts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE
    if chosen:
        names = [n for n in catalog.QUERIES if chosen == "all" or any(n.startswith(p) for p in chosen.split(","))]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
        spark_driver_memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Stored once, as a run of the evaluation writes its scores before it summarises them.
    tables = Tables(spark, folder)
    timings: dict[str, float] = {}
    start = time.perf_counter()
    fixtures.pairwise_scores(tables)
    fixtures.two_by_two_scores(tables)
    timings["store_scores"] = time.perf_counter() - start
    start = time.perf_counter()
    fixtures.document_shards(tables)
    timings["write_shards"] = time.perf_counter() - start
    for name in names:
        # Once to warm up, so that no line pays for the first use of an operator; the second run counts.
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = time.perf_counter() - start
        print(f"{name} {timings[name]:.2f}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in timings.items()},
                "sf": sf,
            }
        )
    )


if __name__ == "__main__":
    main()
