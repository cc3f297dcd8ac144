"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts from the given tables: shared derived tables are dropped before each.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from curbline.plans.registry import QUERIES, forget_scenes

HEADLINE = (
    "ag01_dedup_incidents", "ag02_corridor_ranking", "jn01_points_in_polygon", "jn02_nearest_segment", "jn03_nearest_within", "jn04_nearest_point", "jn06_buffer_overlap",
    "jn09_line_crossings", "rl01_tag_segments", "rl04_classify_incidents", "gr01_cluster_points", "gr03_junction_nodes", "lr02_merged_lines", "gr06_network_count", "se03_street_candidates", "ing02_snapshot_diff",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        forget_scenes()
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
