"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from meridian.plans import QUERIES

NAMES = ("space_profile", "cep_index", "max_3d", "signal_profile_all", "sky_grid", "track_segments", "fix_streak", "rates_from_positions", "error_estimates", "latest_state", "asof_sky", "dop", "prn_range_join", "knn_station", "class_histogram", "ais_bits", "sat_position", "stream_window_stats")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # the session is warm before the first query
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
