"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from pawprint.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["oft_center_bouts", "movement", "interpolate_linear", "oft_summary", "oft_bins", "zone_report", "zone_transitions", "path_geometry", "occupancy_entropy", "event_summary", "following_avoidance", "window_features", "adapter_lineitem_frames", "interval_labels", "habituation_slopes", "oft_summary_row", "enhanced_full", "socint_all_events", "dyad_file_chain", "smoothed_velocity", "group_covariates"]


def lineitem_suite(spark, sf_dir):
    """The whole enhanced row of every supplier's track: 600,000 frames at sf0.1."""
    from pawprint.plans.oft import frame_table
    from pawprint.plans.oft_rows import enhanced_full
    from pawprint.queries import CFG
    from pawprint.sources.adapters import pose_from_lineitem

    return enhanced_full(frame_table(pose_from_lineitem(spark, sf_dir), CFG), CFG)


RUNS = {**{n: QUERIES[n] for n in NAMES}, "lineitem_suite": lineitem_suite}


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, run in RUNS.items():
        times = []
        for _ in range(3):
            start = time.perf_counter()
            run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
    frames = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    print(json.dumps({"metric": "median seconds of headline queries, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "frames_per_second_oft_summary": round(frames / took["oft_summary"])}))


if __name__ == "__main__":
    main()
