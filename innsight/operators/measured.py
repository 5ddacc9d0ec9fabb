"""Weather and demand as the price history has measured them.

The history is reduced to sums and counts by hotel, month and weekday, which can be
kept and added to day by day; what a search or forecast reads is a profile per hotel
made of them, never the history.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.sources.parts import PartTable

DIGITS = 9  # of a mean
CELL = ["hotel_id", "month", "weekday"]
_EXACT = "decimal(18,12)"  # of a score; sums of decimals do not depend on their order
_TOTAL = "decimal(38,12)"
_SUMS = (
    f"hotel_id long, month int, weekday int, weather_total {_TOTAL}, weather_count long, "
    f"demand_total {_TOTAL}, demand_count long"
)


def signal_sums(history: DataFrame) -> DataFrame:
    """(hotel_id, month, weekday, weather_total, weather_count, demand_total,
    demand_count) of a history, Monday 0. Combines ahead of the shuffle, to 84 rows per
    hotel. Missing scores, and rows without a date, count for nothing."""
    dated = history.where("recorded_date is not null")
    scores = {
        f"{name}_exact": F.expr(f"try_cast({name}_score as {_EXACT})") for name in ("weather", "demand")
    }
    return (
        dated.withColumns(scores)
        .groupBy("hotel_id", F.month("recorded_date").alias("month"), F.weekday("recorded_date").alias("weekday"))
        .agg(*_totals(F.sum("weather_exact"), F.count("weather_exact"), F.sum("demand_exact"), F.count("demand_exact")))
    )


def _totals(*values: Column) -> list[Column]:
    names = ("weather_total", "weather_count", "demand_total", "demand_count")
    kinds = (_TOTAL, "long", _TOTAL, "long")
    return [v.cast(kind).alias(name) for v, kind, name in zip(values, kinds, names)]


def merged_sums(sums: DataFrame) -> DataFrame:
    """Sums of several histories as those of their union."""
    names = ("weather_total", "weather_count", "demand_total", "demand_count")
    return sums.groupBy(*CELL).agg(*_totals(*(F.sum(n) for n in names)))


def measured_profiles(sums: DataFrame) -> DataFrame:
    """(hotel_id, weather_by_month, demand_by_weekday): one row per hotel with maps of at
    most twelve and seven means. One shuffle, by hotel, of rows that are sums already."""
    slots = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(kind).alias("kind"),
                    F.col(slot).alias("slot"),
                    F.col(f"{kind}_total").alias("total"),
                    F.col(f"{kind}_count").alias("n"),
                )
                for kind, slot in (("weather", "month"), ("demand", "weekday"))
            ]
        )
    )
    means = (
        sums.repartition("hotel_id")
        .select("hotel_id", slots)
        .groupBy("hotel_id", "kind", "slot")
        .agg(F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"))
        .where("n > 0")
        .withColumn("mean", F.round(F.col("total") / F.col("n"), DIGITS))
    )

    def by(kind: str) -> Column:
        entry = F.when(F.col("kind") == kind, F.struct("slot", "mean"))
        return F.map_from_entries(F.collect_list(entry))

    return means.groupBy("hotel_id").agg(
        by("weather").alias("weather_by_month"), by("demand").alias("demand_by_weekday")
    )


def with_profiles(rows: DataFrame, profiles: DataFrame, few: bool = False) -> DataFrame:
    """Rows with the maps of their hotel; ``few`` says that there are few profiles, as
    with those of a limited search."""
    return rows.join(F.broadcast(profiles) if few else profiles, "hotel_id", "left")


def with_measured(
    rows: DataFrame, profiles: DataFrame | None, date: str = "date", few: bool = False
) -> DataFrame:
    """Adds measured_weather and measured_demand to rows that have ``hotel_id`` and a
    date column; null where nothing was measured.

    Rows that have the maps of ``with_profiles`` already are not joined again.
    """
    if "weather_by_month" not in rows.columns:
        if profiles is None:
            nothing = F.lit(None).cast("double")
            return rows.withColumns({"measured_weather": nothing, "measured_demand": nothing})
        rows = with_profiles(rows, profiles, few)
    return rows.withColumns(
        {
            "measured_weather": F.try_element_at("weather_by_month", F.month(date)),
            "measured_demand": F.try_element_at("demand_by_weekday", F.weekday(date)),
        }
    ).drop("weather_by_month", "demand_by_weekday")


class SignalSummary:
    """The sums of a growing history, kept at a folder.

    Days are folded in as they come, in any order, and each counts once: a job that
    runs again for a day, or for days that are all there, changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.parts = PartTable(spark, path)

    def fold_in(self, history: DataFrame, first: dt.date, last: dt.date | None = None) -> bool:
        """Adds the rows of a day, or of all days up to ``last``; of ``history`` no others
        are read. False if these days are there already."""
        last = last or first
        days = history.where(F.col("recorded_date").between(F.lit(first), F.lit(last)))
        return self.parts.put(first.toordinal(), signal_sums(days), last.toordinal())

    def compact(self) -> bool:
        """Makes one table, in the order of hotels, of what was folded in day by day. To be
        run now and then: sums read every day apart until it is."""

        def merge(sums: DataFrame) -> DataFrame:
            return merged_sums(sums).repartitionByRange("hotel_id").sortWithinPartitions(*CELL)

        return self.parts.fold(merge)

    def sums(self) -> DataFrame:
        """What was folded in; a cell has a row for each day or compaction that has it."""
        return self.parts.read(T.StructType.fromDDL(_SUMS))
