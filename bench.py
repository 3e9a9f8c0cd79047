"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from ridgeline import catalog

HEADLINE = (
    "vector_topk_state_filtered", "vector_topk", "weighted_two_view_topk", "aligned_similarity_topk", "head_rerank_blend", "graded_ndcg", "metric_block_by_label", "farthest_point_selection",
    "ratings_latest_wins", "consensus_majority", "roc_auc", "hash_group_split", "log_profile", "valley_between_peaks", "curve_descriptor",
    "fingerprint_dedup", "upsert_latest", "rolling_24h_count", "manifest_validation", "variant_rollup",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf.rstrip("/")).removeprefix("sf") or 0)}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
