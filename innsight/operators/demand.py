"""Demand per place and date, with events from a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions.signals import demand_signal, measured_demand_signal
from innsight.operators.lookup import lookup, measured_bytes
from innsight.operators.measured import DIGITS


def with_demand(
    rows: DataFrame, calendar: DataFrame | None, date: str = "date", few: bool = False
) -> DataFrame:
    """Adds ``demand_score`` to rows that have ``city`` and a date column. ``few`` says that
    the calendar holds few places and dates, so that it need not be measured.

    Several events of one city and day count once, with the largest uplift. Rows may
    have a column measured_demand (see ``with_measured``); where it is not null it
    takes the place of the modelled base.
    """

    def score(uplift) -> Column:
        modelled = demand_signal(date, uplift)
        if "measured_demand" not in rows.columns:
            return modelled
        measured = measured_demand_signal("measured_demand", uplift)
        return F.coalesce(F.round(measured, DIGITS), modelled)

    if calendar is None:
        return rows.withColumn("demand_score", score(F.lit(0.0)))
    events = (
        calendar.withColumnRenamed("date", date)
        .groupBy("city", date)
        .agg(F.max("uplift").alias("uplift"))
    )
    # the calendar as it is stored bounds what is drawn from it
    size = 0 if few else measured_bytes(calendar.select("city", "date", "uplift"))
    return (
        lookup(rows, events, ["city", date], "left", salt=["hotel_id"], at_most_bytes=size)
        .withColumn("demand_score", score(F.col("uplift")))
        .drop("uplift")
    )
