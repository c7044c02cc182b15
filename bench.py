"""Time the headline queries on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from foliospark.plans.catalog import QUERIES

HEADLINE = [
    "redaction_report", "task_outputs", "purge_cascade", "orphan_tasks", "cleanup_report", "quota_check", "daily_usage", "status_changes",
    "latest_status", "subscription_fold", "fixed_window_limit", "client_key", "download_name", "parse_number", "diff_summary", "line_diff",
    "find_text", "replace_text", "best_candidate", "target_size", "merge_pages", "organize_pages", "page_list", "url_screen", "find_columns",
    "flow_paragraphs", "same_row_merge", "box_merge", "list_groups", "split_runs", "bookmark_remap", "retention_sweep", "zip_names", "sliding_limiter", "paragraphs",
    "reading_order", "tab_segments", "line_size", "word_in_grid", "table_rows", "table_continuation", "edit_ops_parse", "ranked_search",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "headline query total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
