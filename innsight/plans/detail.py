"""Hotel profile: the hotel, its newest reviews, amenities and current price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions import constants as C
from innsight.functions.signals import date_ahead
from innsight.operators.latest import latest_reviews
from innsight.operators.measured import measured_profiles
from innsight.operators.nights import booked_nights
from innsight.plans.pricing import price_rows


def parse_amenities(column) -> Column:
    """JSON text to a list; broken text gives null."""
    return F.from_json(column, "array<string>")


def hotel_reviews(hotels: DataFrame, reviews: DataFrame, k: int = C.DETAIL_REVIEWS) -> DataFrame:
    """Every hotel with the list of its newest ``k`` reviews, empty when none.

    Reviews are cut to k per hotel before the shuffle, so the lists are short and
    a much reviewed hotel is no heavier than others.
    """
    own = [name for name in reviews.columns if name != "hotel_id"]
    newest = latest_reviews(reviews, k)
    row = F.struct("review_rank", *own)
    lists = newest.groupBy("hotel_id").agg(F.sort_array(F.collect_list(row)).alias("ranked"))
    plain = F.transform(
        F.coalesce("ranked", F.array()),
        lambda item: F.struct(*[item[name].alias(name) for name in own]),
    )
    return (
        hotels.join(lists, "hotel_id", "left").withColumn("reviews", plain).drop("ranked")
    )


def hotel_detail(
    hotels: DataFrame,
    reviews: DataFrame,
    as_of=None,
    bookings: DataFrame | None = None,
    calendar: DataFrame | None = None,
    sums: DataFrame | None = None,
    k: int = C.DETAIL_REVIEWS,
) -> DataFrame:
    """The profile of all hotels; filter ``hotels`` by id for one. Of the bookings only
    those of the night priced are read, into one row per hotel. ``sums`` are those of
    the price history, as kept by a ``SignalSummary``. An unknown id gives an empty
    frame."""
    today = date_ahead(as_of, F.lit(0))
    nights = None
    if bookings is not None:
        # the night's bookings are reduced to one row per hotel before they meet
        nights = booked_nights(bookings, today, today)
    rows = hotel_reviews(hotels, reviews, k).withColumns(
        {"date": today, "days_ahead": F.lit(1)}
    )
    priced = price_rows(
        rows,
        "days_ahead",
        calendar=calendar,
        span=(today, today),
        profiles=None if sums is None else measured_profiles(sums),
        nights=nights,
    )
    return priced.withColumns(
        {
            "amenities": parse_amenities("amenities"),
            "current_price": F.round("raw_price", 2),
        }
    ).withColumnsRenamed({"weather": "current_weather", "demand_score": "current_demand"})
