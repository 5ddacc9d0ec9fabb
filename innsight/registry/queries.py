"""Every operator as a query over one folder of test tables.

Dates and times are shown as text and measured doubles rounded, so that results
of two engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions import constants as C
from innsight.functions import features, geo, signals
from innsight.functions import pricing as P
from innsight.functions.sql import register_sql_functions
from innsight.operators.audit import integrity_audit as run_audit
from innsight.operators.demand import with_demand
from innsight.operators.latest import latest_reviews as newest
from innsight.operators.lookup import lookup
from innsight.operators.measured import measured_profiles, signal_sums, with_measured
from innsight.operators.nights import booked_nights as taken_nights
from innsight.operators.nights import supply_factors
from innsight.operators.radius import top_within_radius
from innsight.plans import bookings as booking_plans
from innsight.plans import detail, forecast, history, market, model, optimisation, search
from innsight.registry.views import Views
from innsight.sources.schemas import TABLES
from innsight.sources.scratch import scratch_folder
from innsight.sources.tables import (
    from_json_documents,
    keyed,
    load_table,
    to_json_documents,
    with_month,
    write_json,
    write_table,
)
from innsight.streaming.demand import demand_windows
from innsight.streaming.reprice import reprice
from innsight.streaming.sinks import run_append, run_update

AS_OF = "1998-06-01"
UNTIL = "1998-06-30"
YEAR = 365
CITY = "NATION_3"
HOTEL = 7
# a point and radius that hold hotels at every scale of the test data
POINT = (-45.0, -143.0)
RADIUS_KM = 5000.0
BATCH_RADIUS_KM = 1000.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Registers a function of the views under its name."""
    QUERIES[build.__name__] = lambda spark, folder: build(Views(spark, folder))
    return build


def _text(date: str) -> Column:
    return signals.date_text(date).alias(date)


def _moment(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _rounded(digits: int, *columns: str) -> list[Column]:
    return [F.round(name, digits).alias(name) for name in columns]


def _significant(*columns: str) -> list[Column]:
    """Prices to the seven digits of a float: decimals are exact halves of each
    other too often for rounding to agree between engines."""
    return [F.col(name).cast("float").cast("double").alias(name) for name in columns]


def _supply(views: Views, until: str = UNTIL) -> DataFrame:
    return supply_factors(views.bookings, views.hotels, AS_OF, until)


def _market(views: Views) -> DataFrame:
    return market.market_columns(views.hotels, AS_OF, _supply(views, AS_OF))


def _signal_rows(views: Views) -> DataFrame:
    """History rows as pricing requests: a supply factor and days ahead each."""
    return views.price_history.select(
        "hotel_id",
        "l_orderkey",
        "l_linenumber",
        "weather_score",
        "demand_score",
        (F.lit(1.0) - F.col("occupancy_rate") / 100.0).alias("supply_factor"),
        F.pmod(F.col("l_orderkey") * 37, F.lit(91)).cast("int").alias("days_ahead"),
        "price",
    )


# --- sources and sinks --------------------------------------------------------


@query
def scan_hotels(views: Views) -> DataFrame:
    return views.hotels


@query
def scan_hotels_city(views: Views) -> DataFrame:
    return views.hotels.where(F.col("city") == CITY)


@query
def hotel_lookup(views: Views) -> DataFrame:
    return views.hotels.where(F.col("hotel_id") == HOTEL)


@query
def scan_price_history(views: Views) -> DataFrame:
    return views.price_history.withColumn("recorded_date", _text("recorded_date"))


@query
def scan_reviews(views: Views) -> DataFrame:
    return views.reviews.withColumn("created_at", _moment("created_at"))


@query
def load_with_defaults(views: Views) -> DataFrame:
    """Hotels written with gaps, loaded through the declared schema and defaults."""
    spark, path = views.spark, scratch_folder(views.spark, "hotels")
    gaps = {
        "amenities": F.when(F.pmod("hotel_id", F.lit(3)) != 2, F.col("amenities")),
        "rating": F.when(F.pmod("hotel_id", F.lit(2)) == 0, F.lit(3.5)),
        "address": F.when(F.pmod("hotel_id", F.lit(5)) != 1, F.concat(F.lit("1 "), F.col("name"))),
    }
    stored = views.hotels.withColumns(gaps).withColumnRenamed("hotel_id", "id")
    write_table(stored, path, sort_by="id")
    loaded = keyed(load_table(spark, "hotels", path), "hotels")
    # the default of the time of entry is now, for every row
    entered = F.date_diff(F.current_timestamp(), "created_at").between(0, 1)
    return loaded.withColumn("entered_now", entered).drop("created_at")


@query
def write_history_by_month(views: Views) -> DataFrame:
    """History written in month folders sorted by hotel, read back by month."""
    path = scratch_folder(views.spark, "history")
    write_table(with_month(views.price_history, "recorded_date"), path, "month_start", "hotel_id")
    months = views.spark.read.parquet(path).groupBy("month_start")
    return months.agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.sum("occupancy_rate"), 4).alias("occupancy_total"),
        F.max("price").alias("peak_price"),
    ).withColumn("month_start", _text("month_start"))


@query
def json_text(views: Views) -> DataFrame:
    """What was written as JSON, read back as plain text and parsed by path."""
    path = scratch_folder(views.spark, "json")
    write_json(views.hotels, path)
    lines = views.spark.read.text(path)
    shown = {"hotel_id": "bigint", "name": "string", "lat": "double", "amenities": "string"}
    return lines.select(
        *[F.get_json_object("value", f"$.{k}").cast(t).alias(k) for k, t in shown.items()]
    )


@query
def json_documents(views: Views) -> DataFrame:
    """Hotels to JSON texts and back."""
    documents = to_json_documents(views.hotels)
    return from_json_documents(documents, views.hotels.schema)


# --- projections --------------------------------------------------------------


@query
def price_multipliers(views: Views) -> DataFrame:
    return _signal_rows(views).select(
        "l_orderkey",
        "l_linenumber",
        "hotel_id",
        P.weather_multiplier("weather_score").alias("weather_multiplier"),
        F.round(P.demand_multiplier("demand_score"), 8).alias("demand_multiplier"),
        P.scarcity_multiplier("supply_factor").alias("scarcity_multiplier"),
        P.urgency_multiplier("days_ahead").alias("urgency_multiplier"),
        P.urgency_label("days_ahead").alias("urgency"),
    )


def _priced(views: Views) -> DataFrame:
    return reprice(_signal_rows(views).drop("price"), views.hotels)


@query
def dynamic_price(views: Views) -> DataFrame:
    return _priced(views).select(
        "l_orderkey", "l_linenumber", "hotel_id", F.round("raw_price", 4).alias("price")
    )


@query
def sql_dynamic_price(views: Views) -> DataFrame:
    """The same through the SQL functions, in SQL text."""
    register_sql_functions(views.spark)
    return views.spark.sql(
        """
        SELECT l_orderkey, l_linenumber, hotel_id,
               round(base_price * weather_multiplier(weather_score)
                   * demand_multiplier(demand_score) * scarcity_multiplier(supply_factor)
                   * urgency_multiplier(days_ahead), 4) AS price,
               abs(dynamic_price(base_price, weather_score, demand_score, supply_factor,
                                 days_ahead) - raw_price) <= 0.0051 AS whole_price_agrees,
               price_tier(base_price) AS tier
        FROM {rows}
        """,
        rows=_priced(views),
    )


@query
def history_price(views: Views) -> DataFrame:
    return views.price_history.select("l_orderkey", "l_linenumber", "hotel_id", "price")


@query
def price_change(views: Views) -> DataFrame:
    """Change of the history price against the base price, rooms left and factors."""
    hotels = views.hotels.select("hotel_id", "base_price", "total_rooms")
    return (
        lookup(_signal_rows(views), hotels, ["hotel_id"], "inner")
        .withColumn(
            "factors",
            P.price_factors("weather_score", "demand_score", "supply_factor", "days_ahead"),
        )
        .select(
            "l_orderkey",
            "l_linenumber",
            "hotel_id",
            P.raw_price_change("price", "base_price").alias("price_change_pct"),
            P.available_rooms("total_rooms", "supply_factor").alias("available_rooms"),
            F.col("factors.time_urgency").alias("time_urgency"),
        )
    )


@query
def market_columns(views: Views) -> DataFrame:
    return _market(views).select("hotel_id", "occupancy", "revenue", "tier")


@query
def hotel_amenities(views: Views) -> DataFrame:
    parsed = views.hotels.select("hotel_id", detail.parse_amenities("amenities").alias("list"))
    return parsed.select("hotel_id", F.explode_outer("list").alias("amenity"))


@query
def calendar_columns(views: Views) -> DataFrame:
    ahead = signals.date_ahead(F.col("check_in"), F.col("rooms"))
    return views.bookings.select(
        "booking_id",
        _text("check_in"),
        signals.date_text(ahead).alias("later"),
        signals.month_of("check_in").cast("long").alias("month"),
        signals.weekday_of("check_in").cast("long").alias("weekday"),
    )


@query
def feature_columns(views: Views) -> DataFrame:
    rows = features.with_features(history.with_hotel_columns(views.price_history, views.hotels))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "hotel_id",
        "star_rating",
        "price_ratio",
        "demand_weather_interaction",
        "occupancy_normalized",
    )


@query
def hotel_distance(views: Views) -> DataFrame:
    distance = geo.distance_km(C.SEARCH_LAT, C.SEARCH_LON, "lat", "lon")
    return views.hotels.select("hotel_id", F.round(distance, 6).alias("distance_km"))


@query
def scalar_math(views: Views) -> DataFrame:
    lat = F.radians("lat")
    return views.hotels.select(
        "hotel_id",
        *[
            F.round(value, 9).alias(name)
            for name, value in {
                "radians": lat,
                "sine": F.sin(lat),
                "cosine": F.cos(lat),
                "arc": F.acos(F.cos(lat)),
                "power": F.pow(F.abs("lat") / 90.0, F.lit(1.4)),
                "half_turn": F.pi() * F.col("lat") / 180.0,
                "clamped": F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("lat"))),
            }.items()
        ],
        F.col("lat").cast("int").alias("truncated"),
    )


def _hotel_year(views: Views) -> DataFrame:
    return views.hotels.select(
        "hotel_id", "city", "lat", F.explode(F.sequence(F.lit(0), F.lit(YEAR - 1))).alias("k")
    ).withColumn("date", signals.date_ahead(AS_OF, "k"))


@query
def weather_signal(views: Views) -> DataFrame:
    """Measured weather of every hotel on every day of a year."""
    rows = with_measured(_hotel_year(views), measured_profiles(signal_sums(views.price_history)))
    weather = signals.weather_signal("lat", "date", measured_score="measured_weather")
    return rows.withColumn("weather", weather).select(
        "hotel_id", _text("date"), "weather.score", "weather.condition"
    )


@query
def demand_signal(views: Views) -> DataFrame:
    """Measured demand with the uplift of events."""
    rows = with_measured(_hotel_year(views), measured_profiles(signal_sums(views.price_history)))
    rows = with_demand(rows, views.events_calendar)
    return rows.select("hotel_id", _text("date"), "demand_score")


@query
def hotel_days_grid(views: Views) -> DataFrame:
    rows = forecast.price_forecast(views.hotels, AS_OF)
    return rows.select("hotel_id", F.col("day_offset").cast("long"), _text("date"))


# --- joins --------------------------------------------------------------------


@query
def history_with_hotels(views: Views) -> DataFrame:
    joined = history.with_hotel_columns(views.price_history, views.hotels)
    return joined.select(
        "l_orderkey", "l_linenumber", "hotel_id", "city", "star_rating", "base_price", "price"
    )


@query
def bucketed_history_with_hotels(views: Views) -> DataFrame:
    """The same from tables stored by buckets of the hotel; no history row moves."""
    stored = views.bucketed("price_history", "lineitem", ["recorded_date"])
    joined = stored.lookup(views.bucketed("hotels", "supplier", []))
    return joined.select(
        "l_orderkey", "l_linenumber", "hotel_id", "city", "star_rating", "base_price", "price"
    )


@query
def bucketed_hotel_stats(views: Views) -> DataFrame:
    stored = views.bucketed("price_history", "lineitem", ["recorded_date"])
    return _stats_row(stored.grouped(history.price_statistics))


@query
def bucketed_latest_reviews(views: Views) -> DataFrame:
    """The newest reviews of every hotel, from reviews stored by buckets of the hotel."""
    rows = views.bucketed("reviews", "events", ["created_at"]).grouped(
        lambda reviews: newest(reviews, C.DETAIL_REVIEWS)
    )
    return rows.select(
        "hotel_id",
        F.col("review_rank").cast("long"),
        "review_id",
        "reviewer_name",
        "rating",
        _moment("created_at"),
    )


@query
def latest_reviews(views: Views) -> DataFrame:
    rows = newest(views.reviews, C.DETAIL_REVIEWS)
    return rows.select(
        "hotel_id",
        F.col("review_rank").cast("long"),
        "review_id",
        "reviewer_name",
        "rating",
        _moment("created_at"),
    )


@query
def hotel_reviews(views: Views) -> DataFrame:
    """The nested review lists, one row per entry."""
    nested = detail.hotel_reviews(views.hotels.select("hotel_id", "name"), views.reviews)
    flat = nested.select(
        "hotel_id", "name", F.size("reviews").cast("long").alias("shown"), F.inline_outer("reviews")
    )
    return flat.select("hotel_id", "name", "shown", "review_id", "rating", "comment")


# --- composite queries --------------------------------------------------------


@query
def search_radius(views: Views) -> DataFrame:
    found = top_within_radius(views.hotels, *POINT, RADIUS_KM)
    return found.select("hotel_id", "name", "star_rating", *_rounded(6, "distance_km"))


@query
def search_laid_out(views: Views) -> DataFrame:
    """The same on hotels that were written along a curve through the plane."""
    path = scratch_folder(views.spark, "hotels-by-place")
    write_table(views.hotels, path, near=("lat", "lon"))
    stored = views.spark.read.schema(views.hotels.schema).parquet(path)
    found = top_within_radius(stored, *POINT, RADIUS_KM)
    return found.select("hotel_id", "name", "star_rating", *_rounded(6, "distance_km"))


def _near(shown, exact, digits: int) -> Column:
    """Whether a displayed number is the exact one to its digits. Engines round exact
    halves differently, so the numbers themselves are compared unrounded."""
    return F.abs(F.col(shown) - exact) <= 0.5 * 10.0**-digits + 1e-9


def _search_row(found: DataFrame) -> DataFrame:
    change = P.raw_price_change("raw_price", "base_price")
    shown = (
        _near("optimized_price", F.col("raw_price"), 2)
        & _near("price_change_pct", P.raw_price_change("optimized_price", "base_price"), 1)
        & _near("price_factors.weather", F.col("weather.score"), 2)
        & _near("price_factors.demand", F.col("demand_score"), 2)
        & _near("price_factors.supply", F.lit(1.0) - F.col("supply_factor"), 2)
    )
    return found.select(
        "hotel_id",
        "name",
        "star_rating",
        *_rounded(6, "distance_km"),
        *_significant("raw_price"),
        F.round(change, 6).alias("change_pct"),
        shown.alias("shown_as_rounded"),
        "demand_score",
        "supply_factor",
        "available_rooms",
        F.col("weather.score").alias("weather_score"),
        F.col("weather.condition").alias("condition"),
        F.col("price_factors.time_urgency").alias("time_urgency"),
    )


def _found(views: Views, limit: int = C.SEARCH_LIMIT) -> DataFrame:
    return search.search_hotels(
        views.hotels,
        *POINT,
        RADIUS_KM,
        limit=limit,
        as_of=AS_OF,
        bookings=views.bookings,
        calendar=views.events_calendar,
        sums=views.signal_sums,
    )


@query
def search_hotels(views: Views) -> DataFrame:
    return _search_row(_found(views))


@query
def search_document(views: Views) -> DataFrame:
    """The nested answer with a limit of its own, one row per entry."""
    document = search.search_document(_found(views, limit=7))
    flat = document.select("total", F.posexplode("hotels").alias("position", "hotel"))
    return _search_row(flat.select("total", "position", "hotel.*")).join(
        flat.select("hotel.hotel_id", "total", F.col("position").cast("long").alias("position")),
        "hotel_id",
    )


@query
def search_batch(views: Views) -> DataFrame:
    found = search.search_batch(views.hotels, views.query_points, BATCH_RADIUS_KM)
    return found.select(
        "point_id",
        F.col("result_rank").cast("long"),
        "hotel_id",
        "star_rating",
        *_rounded(4, "distance_km"),
    )


def _forecast(views: Views) -> DataFrame:
    return forecast.price_forecast(
        views.hotels,
        AS_OF,
        C.FORECAST_DAYS,
        views.bookings,
        views.events_calendar,
        views.signal_sums,
    )


@query
def price_forecast(views: Views) -> DataFrame:
    return _forecast(views).select(
        "hotel_id",
        "name",
        _text("date"),
        *_significant("raw_price"),
        F.col("weather.score").alias("weather_score"),
        F.col("weather.condition").alias("condition"),
        "demand_score",
        "supply_factor",
    )


@query
def forecast_documents(views: Views) -> DataFrame:
    """The nested day lists, one row per entry with its place in the list."""
    documents = forecast.forecast_documents(_forecast(views))
    flat = documents.select(
        "hotel_id",
        "hotel_name",
        F.size("forecast").cast("long").alias("days"),
        F.posexplode("forecast").alias("position", "day"),
    )
    return flat.select(
        "hotel_id",
        "hotel_name",
        "days",
        F.col("position").cast("long").alias("position"),
        "day.date",
        "day.weather_score",
        "day.demand",
        "day.condition",
    )


@query
def hotel_detail(views: Views) -> DataFrame:
    rows = detail.hotel_detail(
        views.hotels,
        views.reviews,
        AS_OF,
        views.bookings,
        views.events_calendar,
        views.signal_sums,
    )
    shown = F.transform("reviews", lambda r: F.concat_ws("/", r["review_id"], r["reviewer_name"], r["comment"]))
    return rows.select(
        "hotel_id",
        "name",
        F.array_join("amenities", ",").alias("amenities"),
        F.array_join(shown, ",").alias("reviews"),
        F.round(F.aggregate("reviews", F.lit(0.0), lambda a, r: a + r["rating"]), 6).alias("ratings"),
        F.col("raw_price").cast("float").cast("double").alias("raw_price"),
        _near("current_price", F.col("raw_price"), 2).alias("shown_as_rounded"),
        "current_demand",
        F.col("current_weather.score").alias("weather_score"),
        F.col("current_weather.condition").alias("condition"),
    )


def _market_row(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(
        *first,
        "total_hotels",
        *_rounded(8, "avg_occupancy"),
        *_rounded(2, "total_revenue_estimate"),
        *market.TIERS,
    )


@query
def market_summary(views: Views) -> DataFrame:
    return _market_row(market.market_summary(_market(views)))


@query
def market_by_city(views: Views) -> DataFrame:
    return _market_row(market.market_summary(_market(views), ["city"]), "city")


@query
def market_tiers(views: Views) -> DataFrame:
    return market.market_tiers(_market(views))


@query
def top_hotels(views: Views) -> DataFrame:
    return market.top_hotels(_market(views))


@query
def market_document(views: Views) -> DataFrame:
    """The nested market answer, one row per hotel of its list."""
    document = market.market_document(_market(views))
    flat = document.select(
        "total_hotels",
        "total_revenue_estimate",
        "price_distribution.*",
        F.posexplode("top_hotels").alias("position", "hotel"),
    )
    return flat.select(
        "total_hotels",
        "total_revenue_estimate",
        *market.TIERS,
        F.col("position").cast("long").alias("position"),
        F.col("hotel.name").alias("name"),
        F.col("hotel.occupancy").alias("occupancy"),
        F.col("hotel.revenue").alias("revenue"),
        F.col("hotel.stars").alias("stars"),
    )


# --- history ------------------------------------------------------------------



def _stats_row(stats: DataFrame) -> DataFrame:
    return stats.select(
        "hotel_id",
        *_significant("avg_price", "price_volatility"),
        *_rounded(6, "avg_occupancy"),
        "peak_price",
        "floor_price",
        *_rounded(8, "weather_price_correlation", "demand_price_correlation"),
    )


@query
def hotel_stats(views: Views) -> DataFrame:
    return _stats_row(history.hotel_stats(views.price_history, views.hotels))


@query
def hotel_stats_city(views: Views) -> DataFrame:
    return _stats_row(history.hotel_stats(views.price_history, views.hotels, CITY))


@query
def weekly_pattern(views: Views) -> DataFrame:
    rows = history.weekly_pattern(views.price_history)
    return rows.select(
        F.col("weekday").cast("long"), *_rounded(9, "avg_demand"), "records"
    )


@query
def peak_days(views: Views) -> DataFrame:
    rows = history.peak_days(views.price_history)
    return rows.select(
        F.col("weekday").cast("long"),
        *_rounded(9, "avg_demand"),
        F.col("demand_rank").cast("long"),
    )


@query
def monthly_index(views: Views) -> DataFrame:
    rows = history.monthly_index(views.price_history)
    return rows.select(
        F.col("month").cast("long"), *_rounded(9, "avg_demand", "demand_index"), "records"
    )


@query
def correlations(views: Views) -> DataFrame:
    rows = history.correlations(views.price_history, views.bookings)
    return rows.select("factor", *_rounded(8, "correlation"), "pairs")


@query
def rolling_weather(views: Views) -> DataFrame:
    rows = history.rolling_weather(views.price_history)
    return rows.select(
        "hotel_id", _text("recorded_date"), *_rounded(9, "rolling_weather", "demand_score")
    )


@query
def weather_lag(views: Views) -> DataFrame:
    rows = history.weather_lag(views.price_history)
    return rows.select("hotel_id", *_rounded(8, "weather_demand_correlation"), "days")


@query
def competitor_gap(views: Views) -> DataFrame:
    rows = history.competitor_gap(views.price_history, views.hotels)
    return rows.select(
        "hotel_id",
        "city",
        _text("month_start"),
        *_significant("avg_price", "competitor_price"),
        *_rounded(8, "price_gap"),
    )


@query
def run_summary(views: Views) -> DataFrame:
    return history.run_summary(views.price_history)


# --- bookings -----------------------------------------------------------------


@query
def booked_nights(views: Views) -> DataFrame:
    rows = taken_nights(views.bookings, AS_OF, UNTIL)
    return rows.select("hotel_id", _text("night"), "booked_rooms")


@query
def all_booked_nights(views: Views) -> DataFrame:
    """Every night of every stay, without a window."""
    rows = taken_nights(views.bookings)
    return rows.select("hotel_id", _text("night"), "booked_rooms")


@query
def supply_factor(views: Views) -> DataFrame:
    rows = supply_factors(views.bookings, views.hotels)
    return rows.select("hotel_id", _text("night"), "booked_rooms", "supply_factor", "occupancy")


@query
def segments(views: Views) -> DataFrame:
    rows = booking_plans.segments(views.bookings)
    return rows.select(
        "segment",
        "bookings",
        *_rounded(6, "share_pct", "avg_lead_days"),
        *_rounded(4, "avg_price"),
        *_rounded(8, "price_elasticity"),
    )


@query
def recommendations(views: Views) -> DataFrame:
    rows = booking_plans.recommendations(views.price_history, views.bookings)
    return rows.select(
        "recommendation",
        "records",
        *_rounded(4, "group_price", "base_price"),
        *_rounded(7, "uplift_pct"),
        *_rounded(8, "correlation", "confidence"),
    )


@query
def overbooking(views: Views) -> DataFrame:
    rows = booking_plans.overbooking(views.bookings)
    return rows.select(
        "hotel_id", "bookings", *_rounded(9, "cancelled_share", "overbooking_rate")
    )


@query
def early_bird_value(views: Views) -> DataFrame:
    rows = booking_plans.early_bird_value(views.bookings)
    return rows.select("early_bird", "guests", *_rounded(4, "avg_spend"), *_rounded(9, "avg_bookings"))


# --- audit --------------------------------------------------------------------


@query
def integrity_audit(views: Views) -> DataFrame:
    """The declared rules of the stored tables on their views, and further keys of the
    generic tables that are known to repeat or to miss their parents."""
    tables = {
        "hotels": views.hotels,
        "reviews": views.reviews,
        "bookings": views.bookings,
        "price_history": views.price_history,
        "labels": views.table("labels"),
        "documents": views.table("documents"),
        "customer": views.table("customer"),
        "events": views.table("events"),
    }
    declared = {name: TABLES[name] for name in ("hotels", "reviews", "bookings", "price_history")}
    required = {
        name: [c for c in rule.required if c in tables[name].columns]
        for name, rule in declared.items()
    }
    keys = {
        name: [[rule.key_alias]]
        for name, rule in declared.items()
        if rule.key_alias in tables[name].columns
    }
    parents = {
        name: {column: (parent, "hotel_id") for column, (parent, _) in rule.parents.items()}
        for name, rule in declared.items()
    }
    required["bookings"] += ["check_in", "status"]
    keys["price_history"] = [["l_orderkey", "l_linenumber"], ["hotel_id", "recorded_date"]]
    parents["price_history"]["l_orderkey"] = ("bookings", "booking_id")
    parents["bookings"]["guest_id"] = ("customer", "c_custkey")
    parents["events"] = {"user_id": ("hotels", "hotel_id")}
    parents["documents"] = {"doc_id": ("labels", "doc_id")}
    return run_audit(tables, required, keys, parents)


# --- model --------------------------------------------------------------------


def _features(views: Views) -> DataFrame:
    return model.feature_table(views.price_history, views.hotels)


@query
def model_split(views: Views) -> DataFrame:
    return views.price_history.select(
        "l_orderkey", "l_linenumber", "hotel_id", model.in_training().alias("in_training")
    )


@query
def model_features(views: Views) -> DataFrame:
    """The assembled vector, an element a column."""
    assembled = model.assembler().transform(model.complete(_features(views)))
    values = vector_to_array("features")
    return assembled.select(
        "l_orderkey",
        "l_linenumber",
        "hotel_id",
        *[values[i].alias(f"feature_{i}") for i in range(len(C.FEATURES))],
        F.col(C.LABEL).alias("label"),
    )


def _plain(views: Views) -> DataFrame:
    return model.mean_ratio_prediction(_features(views)).where(~model.in_training())


@query
def plain_quality(views: Views) -> DataFrame:
    """RMSE and R2 of the prediction that a model has to beat."""
    rows = model.evaluate(_plain(views), ["city"])
    return rows.select("city", *_rounded(8, "rmse", "r2"), "records")


@query
def plain_adjustment(views: Views) -> DataFrame:
    rows = model.price_adjustment(_plain(views), ["city", "hotel_id"])
    return rows.select("city", "hotel_id", *_rounded(7, "adjustment_pct"), "records")


def _job(views: Views) -> optimisation.Optimisation:
    """One run of the job serves all queries over the same files."""
    tables = [views.table(name) for name in ("lineitem", "supplier", "nation")]
    return optimisation.kept_optimisation(views.price_history, views.hotels, tables)


@query
def model_quality(views: Views) -> DataFrame:
    """Whether the trained forest beats the plain prediction in a city."""
    plain = model.evaluate(_plain(views), ["city"]).withColumnRenamed("rmse", "plain_rmse")
    joined = _job(views).quality.join(plain.select("city", "plain_rmse"), "city")
    better = (F.col("rmse") < F.col("plain_rmse")) & (F.col("r2") > 0.5)
    return joined.select("city", "records", better.alias("beats_plain"))


@query
def optimise(views: Views) -> DataFrame:
    """The whole job, its numbers as rows: what was processed, the statistics of every
    hotel, and how many rows were held out to measure the model."""
    job = _job(views)
    held_out = job.overall.select(
        F.lit("model").alias("part"),
        F.lit(None).cast("long").alias("hotel_id"),
        F.lit("held_out").alias("measure"),
        F.col("records").cast("double").alias("value"),
    )
    figures = optimisation.job_figures(job).unionByName(held_out)
    shown = F.when(F.col("measure").like("%correlation"), F.round("value", 8))
    shown = shown.when(F.col("measure") == "avg_occupancy", F.round("value", 6))
    return figures.withColumn("value", shown.otherwise(F.col("value").cast("float").cast("double")))


@query
def model_metrics(views: Views) -> DataFrame:
    return _job(views).overall


@query
def model_metrics_by_city(views: Views) -> DataFrame:
    return _job(views).quality


@query
def price_adjustment(views: Views) -> DataFrame:
    """How far the trained model would move prices, over the rows held out."""
    cities = views.hotels.select("hotel_id", "city")
    return _job(views).adjustments.join(cities, "hotel_id").select(
        "city", "hotel_id", "adjustment_pct", "records"
    )


# --- streams ------------------------------------------------------------------


@query
def stream_reprice(views: Views) -> DataFrame:
    hotels = views.hotels
    stream = views.signals(views.event_stream())
    priced = run_append(stream, "reprice", lambda batch: reprice(batch, hotels))
    return priced.select(
        "signal_id", "hotel_id", "city", _moment("event_time"), *_rounded(4, "raw_price")
    )


@query
def stream_demand(views: Views) -> DataFrame:
    windows = demand_windows(views.demand_events(views.event_stream()))
    counted = run_update(windows, "demand", ["hotel_id", "window_start", "window_end"])
    return counted.select(
        "hotel_id",
        _moment("window_start"),
        _moment("window_end"),
        "events",
        *_rounded(4, "total_value"),
    )
