"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is planned and run in full into a sink that discards the rows. ``build_tables`` and
``build_predictions`` are the one-time derivations that the other queries read.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from paddock.plans import canonical, predictions
from paddock.suite import QUERIES

HEADLINE = (
    "rolling_position_stats_5",
    "rolling_trends",
    "constructor_rolling_performance",
    "calendar_driver_form",
    "standings_driver",
    "driver_career",
    "driver_base_features",
    "driver_track_stats",
    "head_to_head_rolling",
    "race_driver_features",
    "validation_issues",
    "validation_season_report",
    "score_ranking",
    "prediction_insights",
    "report_predictions",
    "report_overtakes",
    "report_overtaking_hotspots",
    "report_key_insights",
    "model_metrics",
    "session_telemetry",
    "series_outliers",
    "stored_results",
    "csv_requests",
    "trained_ridge_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("paddock-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="paddock-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    spark.range(1000).selectExpr("sum(id)").collect()
    timed("build_tables", lambda: canonical.tables(spark, folder))
    timed("build_predictions", lambda: predictions.predicted(spark, folder))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name].frame(spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
