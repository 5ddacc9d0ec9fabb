"""Feature columns of the price model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions.pricing import _col


def price_ratio(price, base_price) -> Column:
    return F.try_divide(_col(price), _col(base_price))


def demand_weather_interaction(demand, weather) -> Column:
    return _col(demand) * _col(weather)


def occupancy_normalized(occupancy_rate) -> Column:
    return _col(occupancy_rate) / F.lit(100.0)


def with_features(history: DataFrame) -> DataFrame:
    """Adds the three derived columns; needs ``base_price`` on every row."""
    return history.withColumns(
        {
            "price_ratio": price_ratio("price", "base_price"),
            "demand_weather_interaction": demand_weather_interaction(
                "demand_score", "weather_score"
            ),
            "occupancy_normalized": occupancy_normalized("occupancy_rate"),
        }
    )
