"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and run to the end (every row and column, no sink) once to warm up and
then three times; its figure is the median.
"""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import catalogue  # noqa: E402
from rowproof.session import configure  # noqa: E402

HEADLINE = [
    "revenue_by_priority", "agg_where", "agg_first_list", "filter_predicate", "filter_whole_texts",
    "project_extend", "enrich_orders", "enrich_composite", "expand_orders", "key_coverage_report",
    "dedupe_highest", "sort_with_rank", "explode_whole_texts", "union_inputs", "profile_columns",
    "validate_counts", "declared_keys", "lineage_aggregate", "lineage_dedupe", "trace_back", "closure_rows",
    "column_diff", "filter_diff_rows", "multiset_counts", "review_settled", "replay_rows", "call_batches",
    "score_rollup", "spend_by_dimension", "source_csv", "row_code",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("rowproof-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    timed: dict[str, float] = {}
    for name in HEADLINE:
        laps = []
        for lap in range(4):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if lap:
                laps.append(time.perf_counter() - start)
        timed[name] = round(statistics.median(laps), 4)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(timed.values()), 3), "unit": "sec",
                      "queries": timed, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
