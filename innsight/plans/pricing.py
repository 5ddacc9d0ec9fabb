"""Signals and prices for rows of (hotel, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions.pricing import raw_dynamic_price
from innsight.functions.signals import weather_signal
from innsight.operators.demand import with_demand
from innsight.operators.measured import with_measured
from innsight.operators.nights import with_booked, with_supply


def price_rows(
    rows: DataFrame,
    days_ahead: str,
    supply: DataFrame | None = None,
    calendar: DataFrame | None = None,
    date: str = "date",
    span: tuple[Column, Column] | None = None,
    profiles: DataFrame | None = None,
    nights: DataFrame | None = None,
    few: bool = False,
) -> DataFrame:
    """Adds weather, demand_score, supply_factor and the unrounded raw_price.

    ``rows`` needs hotel_id, city, lat, base_price, the date and the days ahead.
    Everything but the optional joins is a projection of the row itself. Weather and
    demand are those that ``profiles`` (see ``measured_profiles``) have for the hotel, the
    modelled ones where they have none. Supply comes from ``supply``, or from booked
    ``nights`` where the rows have the number of rooms.
    ``span`` is the first and last date of the rows, where the caller knows them:
    of supply and calendar only these dates are then read. ``few`` says that the
    optional tables are cut to few hotels and places already.
    """
    if span is not None and supply is not None:
        supply = supply.where(F.col("night").between(*span))
    if span is not None and calendar is not None:
        calendar = calendar.where(F.col("date").between(*span))
    if nights is not None or "booked" in rows.columns:
        rows = with_booked(rows, nights, date, few)
    else:
        rows = with_supply(rows, supply, date)
    rows = with_measured(rows, profiles, date, few)
    rows = with_demand(rows, calendar, date, few)
    weather = weather_signal("lat", date, measured_score="measured_weather")
    rows = rows.withColumn("weather", weather).drop("measured_weather", "measured_demand")
    price = raw_dynamic_price(
        "base_price", F.col("weather.score"), "demand_score", "supply_factor", days_ahead
    )
    return rows.withColumn("raw_price", price)
