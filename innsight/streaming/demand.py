"""Demand per hotel and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def demand_windows(
    events: DataFrame, window: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """Events and their value per hotel and tumbling window.

    Rows behind the watermark are dropped and closed windows leave the state. The
    state holds one row per hotel and open window, and counts combine ahead of
    the shuffle. On a batch the watermark has no effect.
    """
    counted = (
        events.withWatermark("event_time", late)
        .groupBy("hotel_id", F.window("event_time", window).alias("span"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total_value"))
    )
    return counted.select(
        "hotel_id",
        F.col("span.start").alias("window_start"),
        F.col("span.end").alias("window_end"),
        "events",
        "total_value",
    )
