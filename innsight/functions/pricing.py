"""Price formulas as Column expressions (whole-stage codegen, no UDF).

A null input gives a null result, so a missing signal never turns into a price.
The ``raw_*`` forms are unrounded; the others round as a price list shows them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.functions import constants as C


def _col(value: Column | str | float | int) -> Column:
    """Column names stay columns, numbers become literals."""
    if isinstance(value, str):
        return F.col(value)
    if isinstance(value, Column):
        return value
    return F.lit(value)


def weather_multiplier(weather) -> Column:
    return F.lit(C.WEATHER_FLOOR) + _col(weather) * F.lit(C.WEATHER_SPAN)


def demand_multiplier(demand) -> Column:
    return F.lit(C.DEMAND_FLOOR) + F.pow(_col(demand), F.lit(C.DEMAND_EXPONENT)) * F.lit(
        C.DEMAND_SPAN
    )


def history_demand_multiplier(demand) -> Column:
    return F.lit(C.DEMAND_FLOOR) + _col(demand) * F.lit(C.HISTORY_DEMAND_SPAN)


def scarcity_multiplier(supply) -> Column:
    supply = _col(supply)
    premium = (F.lit(C.SCARCITY_START) - supply) * F.lit(C.SCARCITY_SLOPE)
    # greatest() skips nulls, hence the guard
    return F.when(supply.isNotNull(), F.lit(1.0) + F.greatest(F.lit(0.0), premium))


def urgency_multiplier(days_ahead) -> Column:
    days = _col(days_ahead)
    return (
        F.when(days <= C.LAST_MINUTE_DAYS, F.lit(C.LAST_MINUTE_FACTOR))
        .when(days <= C.WEEK_DAYS, F.lit(C.WEEK_FACTOR))
        .when(days >= C.EARLY_BIRD_DAYS, F.lit(C.EARLY_BIRD_FACTOR))
        .when(days.isNotNull(), F.lit(1.0))
    )


def raw_dynamic_price(base_price, weather, demand, supply, days_ahead) -> Column:
    return (
        _col(base_price)
        * weather_multiplier(weather)
        * demand_multiplier(demand)
        * scarcity_multiplier(supply)
        * urgency_multiplier(days_ahead)
    )


def dynamic_price(base_price, weather, demand, supply, days_ahead) -> Column:
    """Base price times the weather, demand, scarcity and urgency multipliers."""
    return F.round(raw_dynamic_price(base_price, weather, demand, supply, days_ahead), 2)


def raw_history_price(base_price, weather, demand, supply) -> Column:
    return (
        _col(base_price)
        * weather_multiplier(weather)
        * history_demand_multiplier(demand)
        * scarcity_multiplier(supply)
    )


def history_price(base_price, weather, demand, supply) -> Column:
    """The price kept in the history: linear in demand and without urgency."""
    return F.round(raw_history_price(base_price, weather, demand, supply), 2)


def raw_price_change(price, base_price) -> Column:
    """Change against the base price in percent; null where the base is zero."""
    base = _col(base_price)
    return F.try_divide(_col(price) - base, base) * F.lit(100.0)


def price_change(price, base_price) -> Column:
    return F.round(raw_price_change(price, base_price), 1)


def available_rooms(total_rooms, supply) -> Column:
    return (_col(total_rooms) * _col(supply)).cast("int")


def urgency_label(days_ahead) -> Column:
    days = _col(days_ahead)
    return (
        F.when(days <= C.LAST_MINUTE_DAYS, "High")
        .when(days <= C.WEEK_DAYS, "Medium")
        .when(days.isNotNull(), "Low")
    )


def price_factors(weather, demand, supply, days_ahead) -> Column:
    """What drove a price, as a struct for display."""
    return F.struct(
        F.round(_col(weather), 2).alias("weather"),
        F.round(_col(demand), 2).alias("demand"),
        F.round(F.lit(1.0) - _col(supply), 2).alias("supply"),
        urgency_label(days_ahead).alias("time_urgency"),
    )


def occupancy_percent(supply) -> Column:
    return (F.lit(1.0) - _col(supply)) * F.lit(100.0)


def revenue_estimate(base_price, total_rooms, supply) -> Column:
    return _col(base_price) * _col(total_rooms) * (F.lit(1.0) - _col(supply))


def price_tier(base_price) -> Column:
    base = _col(base_price)
    return (
        F.when(base < C.BUDGET_BELOW, "budget")
        .when(base < C.MID_BELOW, "mid")
        .when(base.isNotNull(), "luxury")
    )


def lead_time_band(days_ahead) -> Column:
    """The urgency bands by name, for grouping bookings."""
    days = _col(days_ahead)
    return (
        F.when(days <= C.LAST_MINUTE_DAYS, "last_minute")
        .when(days <= C.WEEK_DAYS, "week")
        .when(days >= C.EARLY_BIRD_DAYS, "early_bird")
        .when(days.isNotNull(), "standard")
    )
