"""Times the headline queries and prints one line of JSON.

Each query runs over its whole tables and is written to Spark's noop sink; a first run warms up, the
second counts (page_metrics, which takes minutes, runs once). $BENCH_SF_DIR is the folder of the tables, $BENCH_CPUS the number of threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from leafmill.plans import catalog

QUERIES = (
    "bm25_topk", "hybrid_search", "knn_topk", "doc_freq", "chunk_sections", "grep_regex", "top_phrases", "snapshot_diff", "audit_issues", "page_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in QUERIES:
        for _ in range(1 if name == "page_metrics" else 2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            found[name] = round(time.perf_counter() - began, 3)
        print(name, found[name], file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
