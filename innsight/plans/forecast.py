"""Daily price forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import constants as C
from innsight.functions.signals import date_ahead, date_text
from innsight.operators.measured import measured_profiles, with_profiles
from innsight.operators.nights import booked_nights, nights_by_hotel
from innsight.plans.pricing import price_rows


def price_forecast(
    hotels: DataFrame,
    as_of=None,
    horizon: int = C.FORECAST_DAYS,
    bookings: DataFrame | None = None,
    calendar: DataFrame | None = None,
    sums: DataFrame | None = None,
) -> DataFrame:
    """A price for every hotel on each of the next ``horizon`` days.

    ``sums`` are those of the price history (see ``signal_sums``), as kept by a
    ``SignalSummary``. Booked nights and measured signals join as one row per hotel, and
    the days are generated on that row, so the rows of a forecast are not shuffled.
    Filter ``hotels`` for a single forecast.
    """
    span = (date_ahead(as_of, F.lit(0)), date_ahead(as_of, F.lit(horizon - 1)))
    rooms = [] if bookings is None else ["total_rooms"]
    rows = hotels.select("hotel_id", "name", "city", "lat", "base_price", *rooms)
    if bookings is not None:
        nights = nights_by_hotel(booked_nights(bookings, *span))
        rows = rows.join(nights, "hotel_id", "left")
    if sums is not None:
        rows = with_profiles(rows, measured_profiles(sums))
    offsets = F.sequence(F.lit(0), F.lit(horizon - 1))
    days = rows.withColumn("day_offset", F.explode(offsets)).withColumn(
        "date", date_ahead(as_of, "day_offset")
    )
    priced = price_rows(days, "day_offset", calendar=calendar, span=span)
    return priced.drop("total_rooms").withColumn("price", F.round("raw_price", 2))


def forecast_documents(forecast: DataFrame) -> DataFrame:
    """One row per hotel with its days in order, at most ``horizon`` of them."""
    day = F.struct(
        date_text("date").alias("date"),
        F.col("price"),
        F.col("weather.score").alias("weather_score"),
        F.col("demand_score").alias("demand"),
        F.round("supply_factor", 2).alias("supply"),
        F.col("weather.condition").alias("condition"),
        F.col("weather.temperature").alias("temp"),
    )
    return forecast.groupBy("hotel_id", F.col("name").alias("hotel_name")).agg(
        F.sort_array(F.collect_list(day)).alias("forecast")
    )
