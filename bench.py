"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plainsight import build_session  # noqa: E402
from plainsight.workloads import REGISTRY  # noqa: E402

HEADLINE = [
    "reach", "reach_states", "rule_201", "rule_209", "run_rules", "backward_slice", "print_sink",
    "extract_strings", "method_bodies", "compact_lines", "sensitive_name", "clean_config_value", "attach_context",
    "build_flow_steps", "keep_verified", "findings_by_rule", "dedup_flows", "flow_hash", "contiguous_ranges",
    "label_join", "compare_runs", "cohen_kappa", "suite_metrics", "set_metrics", "roc_auc",
    "diagnostics", "utility", "rollup_tree", "unique_per_repo", "top_repos", "latest_tag", "progress_table",
    "score_batches", "stratified_split",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["confusion"].run(spark, sf_dir).collect()  # start-up is not a query
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every column of every row is computed; nothing comes to the driver
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
