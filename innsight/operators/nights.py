"""Rooms taken and free per hotel and night, from bookings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as_date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def active(bookings: DataFrame) -> DataFrame:
    """The bookings that were not cancelled; a missing status counts as confirmed."""
    return bookings.where(F.coalesce("status", F.lit("confirmed")) != "cancelled")


def booked_nights(bookings: DataFrame, first=None, last=None) -> DataFrame:
    """(hotel_id, night, booked_rooms) over every night from check-in to the one
    before check-out, without cancelled bookings. A booking without a number of
    rooms takes one, which is the column's default.

    A sweep: each stay adds its rooms on the day it begins and takes them away on the
    day it ends, whatever its length. The changes of a day are added up ahead of the
    shuffle, so a hotel has at most as many rows as the calendar has days when its
    running sums are made; nights are generated last, from stretches without change.
    With ``first``/``last`` only stays that touch those nights are read, and they are
    cut to them.
    """
    stays = active(bookings).where(F.col("check_out") > F.col("check_in"))
    start, end = F.col("check_in"), F.col("check_out")
    if first is not None:
        stays = stays.where(F.col("check_out") > _as_date(first))
        start = F.greatest(start, _as_date(first))
    if last is not None:
        stays = stays.where(F.col("check_in") <= _as_date(last))
        end = F.least(end, F.date_add(_as_date(last), 1))
    rooms = F.coalesce("rooms", F.lit(1)).cast("long")
    one = F.lit(1).cast("long")

    def change(day: Column, sign: int) -> Column:
        return F.struct(day.alias("day"), (rooms * sign).alias("rooms"), (one * sign).alias("stays"))

    changes = (
        stays.select("hotel_id", F.inline(F.array(change(start, 1), change(end, -1))))
        .groupBy("hotel_id", "day")
        .agg(F.sum("rooms").alias("rooms"), F.sum("stays").alias("stays"))
    )
    days = Window.partitionBy("hotel_id").orderBy("day")
    so_far = days.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        changes.select(
            "hotel_id",
            "day",
            F.lead("day").over(days).alias("until"),
            F.sum("rooms").over(so_far).alias("booked_rooms"),
            F.sum("stays").over(so_far).alias("stays"),
        )
        .where("stays > 0")  # a stay without rooms is a booked night, too
        .select("hotel_id", F.explode(F.sequence("day", F.date_sub("until", 1))).alias("night"), "booked_rooms")
    )


def free_share(booked_rooms, total_rooms) -> Column:
    """Share of rooms free within 0..1. A hotel that has no rooms has none free; where
    the number of rooms is not known, neither is the share."""
    total = F.col(total_rooms)
    booked = F.col(booked_rooms) if isinstance(booked_rooms, str) else booked_rooms
    taken = F.try_divide(F.coalesce(booked, F.lit(0)).cast("double"), total)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - taken))
    return F.when(total == 0, F.lit(0.0)).when(total.isNotNull(), share)


def supply_factors(bookings: DataFrame, hotels: DataFrame, first=None, last=None) -> DataFrame:
    """Supply factor and occupancy of every hotel-night that has a booking.

    Nights missing here are free: readers join from the left and take 1. Every
    hotel has at most one row per night by the time of the join, so no hotel is
    heavier than the calendar is long.
    """
    rooms = hotels.select("hotel_id", "total_rooms")
    return (
        booked_nights(bookings, first, last)
        .join(rooms, "hotel_id", "inner")
        .withColumn("supply_factor", free_share("booked_rooms", "total_rooms"))
        .withColumn("occupancy", (F.lit(1.0) - F.col("supply_factor")) * F.lit(100.0))
    )


def nights_by_hotel(nights: DataFrame) -> DataFrame:
    """(hotel_id, booked): the booked nights of a hotel as one map from night to rooms,
    for nights of a window, which bounds it."""
    entries = F.collect_list(F.struct("night", "booked_rooms"))
    return nights.groupBy("hotel_id").agg(F.map_from_entries(entries).alias("booked"))


def with_booked(
    rows: DataFrame, nights: DataFrame, date: str = "date", few: bool = False
) -> DataFrame:
    """Adds ``supply_factor`` to rows that have ``hotel_id``, ``total_rooms`` and a date
    column, from the booked nights of a window; 1 where nothing is booked or the
    number of rooms is not known.

    The nights join as one row per hotel, so rows of many dates can be generated after
    this and are not shuffled themselves; rows that have ``booked`` are not joined again.
    ``few`` says that there are few hotels.
    """
    if "booked" not in rows.columns:
        by_hotel = nights_by_hotel(nights)
        rows = rows.join(F.broadcast(by_hotel) if few else by_hotel, "hotel_id", "left")
    taken = F.try_element_at("booked", F.col(date))
    share = F.when(taken.isNotNull(), free_share(taken, "total_rooms"))
    return rows.withColumn("supply_factor", F.coalesce(share, F.lit(1.0))).drop("booked")


def with_supply(
    rows: DataFrame, supply: DataFrame | None, date: str = "date", default: float = 1.0
) -> DataFrame:
    """Adds ``supply_factor`` to rows that have ``hotel_id`` and a date column."""
    if supply is None:
        return rows.withColumn("supply_factor", F.lit(default))
    nights = supply.select("hotel_id", F.col("night").alias(date), "supply_factor")
    return rows.join(nights, ["hotel_id", date], "left").withColumn(
        "supply_factor", F.coalesce("supply_factor", F.lit(default))
    )
