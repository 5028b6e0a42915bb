"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then $BENCH_RUNS times (default 2) with its whole result written to
a sink that discards it; the time reported per query is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from awardsift.catalog import QUERIES
from awardsift.session import local_session

HEADLINES = [
    "award_etl", "award_rollup", "active_awards", "labeled_anti_join", "agency_review_rate", "clean_text", "keyword_substring",
    "prepare_unlabeled", "top_category_mapping", "hashing_embedding", "fused_features", "forest_fit_score",
    "forest_fit_predict_documents", "threshold_sweep", "score_histogram", "score_density", "contamination_offset", "exact_sample",
    "stratified_split", "sorted_scores", "correlation_pairs", "pca_cumulative_variance", "shap_importance",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, spread=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total of per-query medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
