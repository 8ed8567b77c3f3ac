"""Times the two workflows from the source tables, then single operators on the staged grid.

Prints one JSON line. The JVM warms up outside the clock.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from queries.catalog import QUERIES
from wellspark.staging import prepare, release

WORKFLOWS = ("G10_detect", "G11_reference_analysis")
OPERATORS = (
    "D1_dedup_last",
    "D2_common_range",
    "D3_resample_mean",
    "D5_frequency_baseline",
    "D8_tail_thresholds",
    "D9_residual_model",
    "D12_interval_stats",
    "E1_hampel",
    "E8_ewma",
    "F1_feature_frame",
    "G2_event_starts",
    "G4_reference_matching",
    "G7_first_triggers",
    "H2_group_thresholds",
    "J2_points_in_intervals",
    "J5_mark_normal",
    "J8_asof_nearest",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wellspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    for name in WORKFLOWS:
        run(spark, name, sf_dir)
    seconds = {name: run(spark, name, sf_dir) for name in WORKFLOWS}
    run(spark, "G6_detection_records", sf_dir)  # stages the tables the operators below start from
    run(spark, "D13_label_summary", sf_dir)
    seconds |= {name: run(spark, name, sf_dir) for name in OPERATORS}
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": sf, "cpus": cpus}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
