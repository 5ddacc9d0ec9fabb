"""Weather and demand signals as pure functions of place and date.

They stand in where nothing was measured: a measured score replaces the modelled
one, observed temperature or rain replace the modelled ones, and the event uplift
comes from a calendar. Noise columns default to 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.functions import constants as C
from innsight.functions.pricing import _col


def date_ahead(as_of: str | Column | None, days_ahead) -> Column:
    """The date ``days_ahead`` days after ``as_of`` (today when not given)."""
    if as_of is None:
        start = F.current_date()
    elif isinstance(as_of, Column):
        start = as_of
    else:
        start = F.lit(as_of).cast("date")
    return F.date_add(start, _col(days_ahead))


def date_text(date) -> Column:
    return F.date_format(_col(date), "yyyy-MM-dd")


def month_of(date) -> Column:
    return F.month(_col(date))


def weekday_of(date) -> Column:
    """Monday is 0."""
    return F.weekday(_col(date))


def season_factor(date) -> Column:
    months = month_of(date) - F.lit(C.SEASON_ZERO_MONTH)
    return F.sin(months * F.pi() / F.lit(6.0))


def latitude_factor(lat) -> Column:
    return F.lit(1.0) - F.abs(_col(lat)) / F.lit(90.0)


def temperature(lat, date, noise=0.0) -> Column:
    return (
        F.lit(C.TEMPERATURE_BASE)
        + latitude_factor(lat) * F.lit(C.TEMPERATURE_LATITUDE)
        + season_factor(date) * F.lit(C.TEMPERATURE_SEASON)
        + _col(noise)
    )


def rain_probability(lat, noise=0.0) -> Column:
    rain = F.lit(C.RAIN_BASE) - latitude_factor(lat) * F.lit(C.RAIN_LATITUDE) + _col(noise)
    return F.when(rain.isNotNull(), F.greatest(F.lit(0.0), rain))


def _bounded(score: Column) -> Column:
    bounded = F.greatest(F.lit(C.SIGNAL_MIN), F.least(F.lit(C.SIGNAL_MAX), score))
    return F.when(score.isNotNull(), bounded)


def raw_weather_score(temp, rain) -> Column:
    temp, rain = _col(temp), _col(rain)
    warm = F.when(temp.isNotNull(), F.least(temp, F.lit(C.TEMPERATURE_BEST)))
    return _bounded(
        (F.lit(1.0) - rain) * F.lit(C.DRY_WEIGHT)
        + warm / F.lit(C.TEMPERATURE_BEST) * F.lit(C.WARM_WEIGHT)
    )


def condition_bucket(score) -> Column:
    return ((F.lit(1.0) - _col(score)) * F.lit(float(C.CONDITION_STEPS))).cast("int")


def condition_label(score) -> Column:
    labels = F.array(*[F.lit(name) for name in C.CONDITIONS])
    return F.element_at(labels, condition_bucket(score) + F.lit(1))


def weather_signal(
    lat,
    date,
    temp_noise=0.0,
    rain_noise=0.0,
    observed_temp=None,
    observed_rain=None,
    measured_score=None,
) -> Column:
    """Weather at a latitude on a date: a struct with a ``score`` in 0.1..1. Where a
    measured score is given, it and its condition are what counts."""
    temp = temperature(lat, date, temp_noise)
    rain = rain_probability(lat, rain_noise)
    if observed_temp is not None:
        temp = F.coalesce(_col(observed_temp), temp)
    if observed_rain is not None:
        rain = F.coalesce(_col(observed_rain), rain)
    score = raw_weather_score(temp, rain)
    shown = F.round(score, 3)
    if measured_score is not None:
        measured = _bounded(_col(measured_score))
        score, shown = F.coalesce(measured, score), F.coalesce(measured, shown)
    humidity = F.lit(C.HUMIDITY_BASE) + rain * F.lit(C.HUMIDITY_RAIN)
    return F.struct(
        F.round(temp, 1).alias("temperature"),
        F.round(rain * F.lit(100.0), 1).alias("precipitation"),
        condition_label(score).alias("condition"),
        shown.alias("score"),
        F.round(humidity, 1).alias("humidity"),
    )


def season_uplift(date) -> Column:
    month = month_of(date)
    return (
        F.when(month.isin(*C.HIGH_SEASON_MONTHS), F.lit(C.HIGH_SEASON_UPLIFT))
        .when(month.isin(*C.HOLIDAY_MONTHS), F.lit(C.HOLIDAY_UPLIFT))
        .when(month.isNotNull(), F.lit(C.LOW_SEASON_UPLIFT))
    )


def is_weekend(date) -> Column:
    return weekday_of(date) >= F.lit(C.WEEKEND_FROM)


def measured_demand_signal(measured, event_uplift=0.0) -> Column:
    """Measured demand plus the uplift of an event, in 0.1..1; null where nothing was
    measured."""
    return _bounded(_col(measured) + F.coalesce(_col(event_uplift), F.lit(0.0)))


def demand_signal(date, event_uplift=0.0, noise=0.0) -> Column:
    """Demand on a date in 0.1..1: weekday, season and event uplift."""
    weekend = F.when(is_weekend(date), F.lit(C.WEEKEND_UPLIFT)).otherwise(F.lit(0.0))
    event = F.coalesce(_col(event_uplift), F.lit(0.0))
    demand = F.lit(C.DEMAND_BASE) + weekend + season_uplift(date) + event + _col(noise)
    return F.round(_bounded(demand), 3)
