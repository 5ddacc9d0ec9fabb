"""Prices for a stream of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import pricing as P
from innsight.operators.lookup import lookup


def reprice(signals: DataFrame, hotels: DataFrame) -> DataFrame:
    """Every signal row with the price it leads to; null for a hotel that is not known.

    For a batch of signals. A stream runs it on every micro-batch (see
    ``run_append``), so the size of the hotels is measured anew each time and none
    is broadcast that has outgrown the limit meanwhile.
    """
    columns = hotels.select("hotel_id", "city", "base_price")
    price = P.raw_dynamic_price(
        "base_price", "weather_score", "demand_score", "supply_factor", "days_ahead"
    )
    return (
        lookup(signals, columns, ["hotel_id"], "left", salt=["event_time", "days_ahead"])
        .withColumn("raw_price", price)
        .withColumn("price", F.round("raw_price", 2))
    )
