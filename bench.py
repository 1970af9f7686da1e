"""Times the headline queries once each on one JVM and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from glyphmill.queries import QUERIES

HEADLINE = (
    "hybrid_top10", "bm25_or_topk", "bm25_fill", "knn_topk", "lexical_drill_down", "line_chunks", "token_overlap", "references_lines", "snapshot_diff", "ready_join",
    "needs_index", "gc_orphans", "smart_cutoff", "variant_merge", "neighbor_expand", "interval_merge", "budget_pack", "nearest_definition", "watch_bursts", "breadcrumb_expand", "import_resolve", "syntax_chunks", "context_pack",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").collect()  # start the JVM's executor before timing
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
