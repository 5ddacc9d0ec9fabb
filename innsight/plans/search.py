"""Radius search with current prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import constants as C
from innsight.functions import pricing as P
from innsight.functions.signals import date_ahead
from innsight.operators.latest import LOCAL_ROWS, local_rows
from innsight.operators.measured import measured_profiles
from innsight.operators.nights import booked_nights
from innsight.operators.radius import top_within_radius, top_within_radius_of_points
from innsight.plans.pricing import price_rows


def _with_offer(found: DataFrame) -> DataFrame:
    """The columns a search result shows beside the hotel's own."""
    return found.withColumns(
        {
            "optimized_price": F.round("raw_price", 2),
            "available_rooms": P.available_rooms("total_rooms", "supply_factor"),
            "price_factors": P.price_factors(
                F.col("weather.score"), "demand_score", "supply_factor", "days_ahead"
            ),
        }
    ).withColumn("price_change_pct", P.price_change("optimized_price", "base_price"))


def search_hotels(
    hotels: DataFrame,
    lat: float = C.SEARCH_LAT,
    lon: float = C.SEARCH_LON,
    radius_km: float = C.SEARCH_RADIUS_KM,
    as_of=None,
    days_ahead: int = C.SEARCH_DAYS_AHEAD,
    bookings: DataFrame | None = None,
    calendar: DataFrame | None = None,
    sums: DataFrame | None = None,
    limit: int = C.SEARCH_LIMIT,
) -> DataFrame:
    """The best hotels around a point, priced for a stay ``days_ahead`` from
    ``as_of``. ``sums`` are those of the price history (see ``signal_sums``), as kept by
    a ``SignalSummary``.

    The hotels found, at most ``limit``, are computed once and priced. Of the other
    tables only their rows are read, by filters that reach the scans, the bookings and
    events for the night of the stay.
    """
    date = date_ahead(as_of, F.lit(days_ahead))
    found = local_rows(top_within_radius(hotels, lat, lon, radius_km, limit), limit)
    few = limit <= LOCAL_ROWS
    named = found.select("hotel_id", "city").collect() if few else []

    def own(rows: DataFrame, column: str) -> DataFrame:
        if few:
            return rows.where(F.col(column).isin(list({r[column] for r in named})))
        return rows.join(found.select(column).distinct(), column, "left_semi")

    priced = price_rows(
        found.withColumns({"days_ahead": F.lit(days_ahead), "date": date}),
        "days_ahead",
        calendar=None if calendar is None else own(calendar, "city"),
        span=(date, date),
        profiles=None if sums is None else measured_profiles(own(sums, "hotel_id")),
        nights=None if bookings is None else booked_nights(own(bookings, "hotel_id"), date, date),
        few=few,
    )
    return _with_offer(priced)


def search_batch(
    hotels: DataFrame,
    points: DataFrame,
    radius_km: float = C.SEARCH_RADIUS_KM,
    limit: int = C.SEARCH_LIMIT,
) -> DataFrame:
    """The same ranking for a whole table of query points."""
    return top_within_radius_of_points(hotels, points, radius_km, limit)


def search_document(found: DataFrame) -> DataFrame:
    """One row with the list of results, best first, and their number. A search
    is limited, so the list is too."""
    first = (-F.col("star_rating")).alias("order"), F.col("hotel_id").alias("order_id")
    row = F.struct(*first, *found.columns)
    return found.agg(
        F.transform(
            F.sort_array(F.collect_list(row)),
            lambda item: F.struct(*[item[name].alias(name) for name in found.columns]),
        ).alias("hotels"),
        F.count(F.lit(1)).alias("total"),
    )
