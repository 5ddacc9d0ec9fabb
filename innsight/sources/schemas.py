"""Table schemas, required columns, keys and default values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_TEXT, _DATE, _TIME = T.StringType(), T.DateType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


@dataclass(frozen=True)
class Table:
    """What is known about one table.

    ``defaults`` maps a column to a SQL expression used where the value is null;
    ``parents`` maps a column to the (table, key) it must be found in;
    ``key_alias`` is the key's name once tables are joined.
    """

    schema: T.StructType
    key: str
    required: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)
    key_alias: str = "id"


_OF_HOTEL = {"hotel_id": ("hotels", "id")}

TABLES: dict[str, Table] = {
    "hotels": Table(
        _schema(
            id=_LONG,
            name=_TEXT,
            city=_TEXT,
            address=_TEXT,
            lat=_DOUBLE,
            lon=_DOUBLE,
            star_rating=_INT,
            base_price=_DOUBLE,
            total_rooms=_INT,
            amenities=_TEXT,
            description=_TEXT,
            image_url=_TEXT,
            rating=_DOUBLE,
            review_count=_INT,
            created_at=_TIME,
        ),
        key="id",
        key_alias="hotel_id",
        required=(
            "name",
            "city",
            "address",
            "lat",
            "lon",
            "star_rating",
            "base_price",
            "total_rooms",
        ),
        defaults={
            "amenities": "'[]'",
            "rating": "4.0D",
            "review_count": "0",
            "created_at": "current_timestamp()",
        },
    ),
    "reviews": Table(
        _schema(
            id=_LONG,
            hotel_id=_LONG,
            reviewer_name=_TEXT,
            rating=_DOUBLE,
            comment=_TEXT,
            created_at=_TIME,
        ),
        key="id",
        key_alias="review_id",
        required=("hotel_id", "rating"),
        defaults={"created_at": "current_timestamp()"},
        parents=_OF_HOTEL,
    ),
    "bookings": Table(
        _schema(
            id=_LONG,
            hotel_id=_LONG,
            guest_name=_TEXT,
            check_in=_DATE,
            check_out=_DATE,
            rooms=_INT,
            price_paid=_DOUBLE,
            status=_TEXT,
            created_at=_TIME,
        ),
        key="id",
        key_alias="booking_id",
        required=("hotel_id",),
        defaults={
            "rooms": "1",
            "status": "'confirmed'",
            "created_at": "current_timestamp()",
        },
        parents=_OF_HOTEL,
    ),
    "price_history": Table(
        _schema(
            id=_LONG,
            hotel_id=_LONG,
            recorded_date=_DATE,
            price=_DOUBLE,
            occupancy_rate=_DOUBLE,
            weather_score=_DOUBLE,
            demand_score=_DOUBLE,
        ),
        key="id",
        key_alias="history_id",
        required=("hotel_id",),
        parents=_OF_HOTEL,
    ),
    "events_calendar": Table(
        _schema(city=_TEXT, date=_DATE, uplift=_DOUBLE),
        key="city",
        key_alias="city",
        required=("city", "date", "uplift"),
    ),
}

SIGNAL_STREAM = _schema(
    hotel_id=_LONG,
    event_time=_TIME,
    weather_score=_DOUBLE,
    demand_score=_DOUBLE,
    supply_factor=_DOUBLE,
    days_ahead=_INT,
)
