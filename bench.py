"""Times the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from strataline.catalog import QUERIES
from strataline.session import build_session

HEADLINE = [
    "distribution", "length_summary_by_role", "think_rate", "think_length_summary", "system_prompt_stats",
    "top_values", "stratified_head", "stratified_random", "subsample", "extract_combined", "filter_by_length",
    "prefix_sum", "shuffle_rows", "pack_documents", "training_schedule", "checkpoint_composition",
    "half_composition", "check_one_instance", "rolling_mean_trailing", "rolling_mean_centered", "metric_groups",
    "config_references", "scores_by_source", "identity_counts", "pca_by_source", "pc_extremes", "knn_graph",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["distribution"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    found = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()
