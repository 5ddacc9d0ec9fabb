"""Lead-time segments, recommendations, overbooking and guest value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions import constants as C
from innsight.functions.pricing import lead_time_band
from innsight.functions.signals import condition_bucket, is_weekend
from innsight.functions.stats import confidence, safe_corr, safe_slope
from innsight.operators.nights import active


def _log(column: str) -> Column:
    return F.ln(F.when(F.col(column) > 0, F.col(column)))


def segments(bookings: DataFrame) -> DataFrame:
    """Bookings by lead-time band: share, mean lead and price, and how strongly
    the rooms booked react to the price (elasticity). Cancelled ones do not count."""
    bands = active(bookings).groupBy(lead_time_band("lead_days").alias("segment")).agg(
        F.count(F.lit(1)).alias("bookings"),
        F.avg("lead_days").alias("avg_lead_days"),
        F.avg("price_paid").alias("avg_price"),
        safe_slope(_log("price_paid"), _log("rooms")).alias("price_elasticity"),
    )
    total = F.sum("bookings").over(Window.partitionBy())
    return bands.withColumn("share_pct", F.col("bookings") / total * F.lit(100.0))


def _comparison(kind: str, group: Column, base: Column, price: str, factor: Column) -> Column:
    """One finding: the mean price of a group of rows against that of others."""
    chosen, other = F.when(group, F.col(price)), F.when(base, F.col(price))
    uplift = F.try_divide(F.avg(chosen), F.avg(other)) - F.lit(1.0)
    return F.struct(
        F.lit(kind).alias("recommendation"),
        F.count(chosen).alias("records"),
        F.avg(chosen).alias("group_price"),
        F.avg(other).alias("base_price"),
        (uplift * F.lit(100.0)).alias("uplift_pct"),
        safe_corr(factor, price).alias("correlation"),
        confidence(F.avg(chosen), F.stddev_samp(chosen), F.count(chosen)).alias("confidence"),
    )


def recommendations(history: DataFrame, bookings: DataFrame) -> DataFrame:
    """Price uplifts that the data shows: weekends, good weather, early and late
    bookings. Two findings from one pass over the history, two from one pass over
    the bookings that were not cancelled."""
    weekend = is_weekend("recorded_date")
    sunny = condition_bucket("weather_score") == 0
    from_history = history.agg(
        F.array(
            _comparison("weekend_surge", weekend, ~weekend, "price", weekend.cast("double")),
            _comparison("weather_linked", sunny, ~sunny, "price", F.col("weather_score")),
        ).alias("rows")
    )
    lead = F.col("lead_days")
    early, late = lead >= C.EARLY_BIRD_DAYS, lead <= C.LAST_MINUTE_DAYS
    standard = (lead > C.WEEK_DAYS) & (lead < C.EARLY_BIRD_DAYS)
    from_bookings = active(bookings).agg(
        F.array(
            _comparison("early_bird_discount", early, standard, "price_paid", lead),
            _comparison("last_minute_premium", late, standard, "price_paid", lead),
        ).alias("rows")
    )
    return from_history.unionByName(from_bookings).select(F.inline("rows"))


def overbooking(bookings: DataFrame) -> DataFrame:
    """Cancelled share c of every hotel and the rate c / (1 - c) by which it could
    be overbooked; null where everything was cancelled."""
    cancelled = F.avg(F.when(F.col("status") == "cancelled", 1.0).otherwise(0.0))
    shares = bookings.groupBy("hotel_id").agg(
        F.count(F.lit(1)).alias("bookings"), cancelled.alias("cancelled_share")
    )
    rate = F.try_divide(F.col("cancelled_share"), F.lit(1.0) - F.col("cancelled_share"))
    return shares.withColumn("overbooking_rate", rate)


def early_bird_value(bookings: DataFrame) -> DataFrame:
    """Mean spend of guests with at least one early booking, and of the others.
    Cancelled bookings cost nothing and do not count; a booking without guest is a
    guest of its own."""
    guest = F.struct("guest_id", F.when(F.col("guest_id").isNull(), F.col("booking_id")))
    guests = active(bookings).groupBy(guest.alias("guest")).agg(
        F.sum("price_paid").alias("spend"),
        F.count(F.lit(1)).alias("bookings"),
        F.coalesce(F.bool_or(F.col("lead_days") >= C.EARLY_BIRD_DAYS), F.lit(False)).alias(
            "early_bird"
        ),
    )
    return guests.groupBy("early_bird").agg(
        F.count(F.lit(1)).alias("guests"),
        F.avg("spend").alias("avg_spend"),
        F.avg("bookings").alias("avg_bookings"),
    )
