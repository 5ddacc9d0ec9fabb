"""Times the headline queries and prints one JSON line.

Every query runs once to warm up and then three times into a sink that discards
the rows; its time is the median. Folder and cores come from BENCH_SF_DIR and
BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from innsight.registry.queries import QUERIES  # noqa: E402

HEADLINE = (
    "hotel_stats",
    "hotel_stats_city",
    "dynamic_price",
    "feature_columns",
    "price_forecast",
    "search_hotels",
    "search_batch",
    "hotel_detail",
    "latest_reviews",
    "market_by_city",
    "top_hotels",
    "supply_factor",
    "weekly_pattern",
    "correlations",
    "recommendations",
    "weather_lag",
    "competitor_gap",
    "segments",
    "overbooking",
    "early_bird_value",
    "rolling_weather",
    "forecast_documents",
    "write_history_by_month",
    "integrity_audit",
    "model_metrics",
    "price_adjustment",
    "optimise",
    "bucketed_history_with_hotels",
    "bucketed_hotel_stats",
    "stream_reprice",
    "stream_demand",
)
RUNS = 3


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("innsight-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # no stack trace per Column call
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
