"""The accommodation tables as projections of the generic test tables.

Each is what a stored table would hold. The same definitions as SQL text are in
``oracle.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.functions.pricing import raw_history_price
from innsight.operators.bucketed import Bucketed, open_bucketed, write_bucketed
from innsight.operators.measured import SignalSummary
from innsight.sources.runs import kept_run
from innsight.sources.scratch import file_system

_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


_SCHEMAS: dict[tuple[str, int], T.StructType] = {}
BUCKETS = 8  # of the small test tables


def _base_price(key: str) -> Column:
    return (F.lit(3000) + F.pmod(F.col(key) * 7919, F.lit(42000))).cast("double")


class Views:
    """Lazy frames over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        """Reading a file's schema is a job of its own; it is done once for each state of
        a path."""
        path = f"{self.folder}/{name}.parquet"
        files, target = file_system(self.spark, path)
        known = (path, files.getFileStatus(target).getModificationTime())
        if known not in _SCHEMAS:
            _SCHEMAS[known] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[known]).parquet(path)

    def _hotel_number(self, key: str) -> Column:
        """Spreads a key over the hotels."""
        return F.pmod(F.col(key), F.lit(self.hotels_count))

    @cached_property
    def hotels_count(self) -> int:
        return self.table("supplier").count()

    @property
    def hotels(self) -> DataFrame:
        key = F.col("s_suppkey")
        amenities = (
            F.when(key % 3 == 0, '["Pool","Spa","Gym"]')
            .when(key % 3 == 1, '["Restaurant","Bar"]')
            .otherwise("[]")
        )
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("city"))
        return self.table("supplier").join(
            nation, F.col("s_nationkey") == F.col("n_nationkey"), "inner"
        ).select(
            key.alias("hotel_id"),
            F.col("s_name").alias("name"),
            "city",
            (F.lit(-60.0) + F.pmod(key * 37, F.lit(1201)) / F.lit(10.0)).alias("lat"),
            (F.lit(-180.0) + F.pmod(key * 91, F.lit(3600)) / F.lit(10.0)).alias("lon"),
            (F.lit(3) + F.pmod(key, F.lit(3))).cast("int").alias("star_rating"),
            _base_price("s_suppkey").alias("base_price"),
            (F.lit(45) + F.pmod(key * 13, F.lit(348))).cast("int").alias("total_rooms"),
            amenities.alias("amenities"),
        )

    @property
    def price_history(self) -> DataFrame:
        signals = self.table("lineitem").select(
            F.col("l_suppkey").alias("hotel_id"),
            F.to_date("l_shipdate").alias("recorded_date"),
            (F.lit(15.0) + (F.col("l_quantity") - 1.0) * 70.0 / 49.0).alias("occupancy_rate"),
            (F.lit(0.3) + F.lit(7.0) * F.col("l_discount")).alias("weather_score"),
            (F.lit(0.2) + F.lit(8.75) * F.col("l_tax")).alias("demand_score"),
            "l_orderkey",
            "l_linenumber",
        )
        supply = F.lit(1.0) - F.col("occupancy_rate") / 100.0
        price = raw_history_price(
            _base_price("hotel_id"), "weather_score", "demand_score", supply
        )
        return signals.withColumn("price", price)

    @property
    def signal_sums(self) -> DataFrame:
        """The kept sums of the price history. They are made where the
        history files have not been summed before, and read from then on."""

        def build(path: str) -> None:
            history = self.price_history
            first, last = history.agg(F.min("recorded_date"), F.max("recorded_date")).first()
            summary = SignalSummary(self.spark, path)
            if first is not None:
                summary.fold_in(history, first, last)
                summary.compact()
            else:
                history.limit(0).write.parquet(path)

        path = kept_run(self.spark, "signal-sums", [self.table("lineitem")], build, rule=1)
        return SignalSummary(self.spark, path).sums()

    def bucketed(self, name: str, source: str, sort_by: list[str]) -> Bucketed:
        """A view stored by buckets of the hotel, once for the files it is drawn from."""
        view = getattr(self, name)

        def build(path: str) -> None:
            write_bucketed(view, path, "hotel_id", BUCKETS, sort_by)

        path = kept_run(self.spark, f"bucketed-{name}", [self.table(source)], build, rule=1)
        return open_bucketed(self.spark, path)

    @property
    def bookings(self) -> DataFrame:
        key = F.col("o_orderkey")
        created = F.to_date("o_orderdate")
        lead = F.pmod(key * 37, F.lit(91)).cast("int")
        check_in = F.date_add(created, lead)
        nights = (F.lit(1) + F.pmod(key, F.lit(7))).cast("int")
        return self.table("orders").select(
            key.alias("booking_id"),
            self._hotel_number("o_orderkey").alias("hotel_id"),
            F.col("o_custkey").alias("guest_id"),
            created.alias("created_date"),
            lead.alias("lead_days"),
            check_in.alias("check_in"),
            F.date_add(check_in, nights).alias("check_out"),
            (F.lit(1) + F.pmod(key, F.lit(3))).cast("int").alias("rooms"),
            F.col("o_totalprice").alias("price_paid"),
            F.when(F.col("o_orderstatus") == "P", "cancelled")
            .otherwise("confirmed")
            .alias("status"),
        )

    @property
    def reviews(self) -> DataFrame:
        key = F.col("event_id")
        return self.table("events").select(
            key.alias("review_id"),
            self._hotel_number("event_id").alias("hotel_id"),
            F.concat(F.lit("user_"), F.col("user_id")).alias("reviewer_name"),
            (F.lit(3.5) + F.pmod(key * 7, F.lit(16)) / F.lit(10.0)).alias("rating"),
            F.col("event_type").alias("comment"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    @property
    def events_calendar(self) -> DataFrame:
        """Days with large orders count as event days of a city."""
        large = self.table("orders").where(F.col("o_totalprice") >= 400000.0)
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("city"))
        keyed = large.withColumn("n_nationkey", F.pmod("o_custkey", F.lit(25)).cast("int"))
        return keyed.join(nation, "n_nationkey", "inner").select(
            "city",
            F.to_date("o_orderdate").alias("date"),
            F.when(F.col("o_totalprice") >= 450000.0, 0.5).otherwise(0.3).alias("uplift"),
        )

    @property
    def query_points(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("point_id"),
            (F.lit(-90.0) + F.pmod(key * 53, F.lit(1801)) / F.lit(10.0)).alias("point_lat"),
            (F.lit(-180.0) + F.pmod(key * 71, F.lit(3601)) / F.lit(10.0)).alias("point_lon"),
        )

    def event_stream(self) -> DataFrame:
        """The events table as a stream of files. The pattern matches a single file
        as well as a folder of that name; a plain path must be a folder."""
        return self.spark.readStream.schema(_EVENTS).parquet(f"{self.folder}/events*.parquet")

    def demand_events(self, events: DataFrame) -> DataFrame:
        return events.select(
            self._hotel_number("event_id").alias("hotel_id"),
            F.col("ts").cast("timestamp").alias("event_time"),
            "event_type",
            "value",
        )

    def signals(self, events: DataFrame) -> DataFrame:
        key = F.col("event_id")

        def spread(factor: int, low: float, span: float) -> Column:
            return F.lit(low) + F.pmod(key * factor, F.lit(101)) * F.lit(span) / F.lit(100.0)

        return events.select(
            key.alias("signal_id"),
            self._hotel_number("event_id").alias("hotel_id"),
            F.col("ts").cast("timestamp").alias("event_time"),
            spread(13, 0.3, 0.7).alias("weather_score"),
            spread(17, 0.2, 0.7).alias("demand_score"),
            spread(29, 0.15, 0.7).alias("supply_factor"),
            F.pmod(key, F.lit(91)).cast("int").alias("days_ahead"),
        )
