import datetime as dt

import pytest
from data import hotels
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from innsight.functions import pricing as P
from innsight.functions import signals as S
from innsight.functions.sql import register_sql_functions

SCHEMA = "base double, w double, d double, s double, n int, expected double"
GOLDEN = [
    (8500.0, 0.8, 0.7, 0.2, -3, 16214.61),
    (8500.0, 0.8, 0.7, 0.2, 1, 16214.61),
    (8500.0, 0.8, 0.7, 0.2, 2, 16214.61),
    (8500.0, 0.8, 0.7, 0.2, 3, 14268.85),
    (8500.0, 0.8, 0.7, 0.2, 7, 14268.85),
    (8500.0, 0.8, 0.7, 0.2, 8, 12971.69),
    (8500.0, 0.8, 0.7, 0.2, 59, 12971.69),
    (8500.0, 0.8, 0.7, 0.2, 60, 11415.08),
    (10000.0, 1.0, 1.0, 0.0, 0, 32340.00),
    (10000.0, 0.0, 0.0, 1.0, 30, 6375.00),
    (10000.0, 0.5, 0.5, 0.3, 30, 10212.12),
    (0.0, 0.5, 0.5, 0.3, 30, 0.0),
]


def test_dynamic_price_golden(spark):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    for row in df.withColumn("price", P.dynamic_price("base", "w", "d", "s", "n")).collect():
        assert row.price == row.expected


def test_sql_functions_equal_columns(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame(GOLDEN, SCHEMA).withColumns(
        {
            "by_column": P.dynamic_price("base", "w", "d", "s", "n"),
            "by_sql": F.expr("dynamic_price(base, w, d, s, n)"),
            "history_column": P.history_price("base", "w", "d", "s"),
            "history_sql": F.expr("history_price(base, w, d, s)"),
            "tier_column": P.price_tier("base"),
            "tier_sql": F.expr("price_tier(base)"),
        }
    )
    for row in df.collect():
        assert row.by_column == row.by_sql == row.expected
        assert row.history_column == row.history_sql
        assert row.tier_column == row.tier_sql


def test_history_price_is_linear_in_demand(spark):
    row = spark.range(1).select(P.history_price(F.lit(10000.0), 0.5, 0.5, 0.5).alias("p")).first()
    assert row.p == round(10000 * (0.85 + 0.5 * 0.35) * (0.75 + 0.5 * 0.6), 2)


def test_missing_signal_gives_no_price(spark):
    rows = [
        (None, 0.5, 0.5, 0.5, 3),
        (100.0, None, 0.5, 0.5, 3),
        (100.0, 0.5, None, 0.5, 3),
        (100.0, 0.5, 0.5, None, 3),
        (100.0, 0.5, 0.5, 0.5, None),
    ]
    df = spark.createDataFrame(rows, "base double, w double, d double, s double, n int")
    prices = df.select(
        P.dynamic_price("base", "w", "d", "s", "n").alias("p"),
        P.price_tier("base").alias("t"),
        P.urgency_label("n").alias("u"),
    ).collect()
    assert all(row.p is None for row in prices)
    assert prices[0].t is None and prices[4].u is None


def test_tiers_changes_rooms_and_labels(spark):
    df = spark.createDataFrame(
        [(4999.99, 4999.99), (5000.0, 5500.0), (11999.0, 1.0), (12000.0, 15000.0), (0.0, 1.0)],
        "base double, price double",
    ).select(P.price_tier("base").alias("t"), P.price_change("price", "base").alias("c"))
    rows = df.collect()
    assert [row.t for row in rows] == ["budget", "mid", "mid", "luxury", "budget"]
    assert rows[0].c == 0.0 and rows[1].c == 10.0 and rows[3].c == 25.0 and rows[4].c is None
    row = spark.range(1).select(
        P.available_rooms(F.lit(45), F.lit(0.35)).alias("rooms"),
        P.occupancy_percent(F.lit(0.25)).alias("occupancy"),
        P.revenue_estimate(F.lit(100.0), F.lit(10), F.lit(0.25)).alias("revenue"),
        P.price_factors(F.lit(0.456), F.lit(0.5), F.lit(0.25), F.lit(5)).alias("f"),
    ).first()
    assert (row.rooms, row.occupancy, row.revenue) == (15, 75.0, 750.0)
    assert row.f.asDict() == {
        "weather": 0.46,
        "demand": 0.5,
        "supply": 0.75,
        "time_urgency": "Medium",
    }


unit = st.floats(0, 1)


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(st.floats(1, 1e5), unit, unit, unit, st.integers(-5, 400)),
        min_size=20,
        max_size=60,
    )
)
def test_price_properties(spark, rows):
    def price(w="w", d="d", s="s"):
        return P.raw_dynamic_price("base", w, d, s, "n")

    half = {name: F.col(name) / 2 for name in "wds"}
    df = spark.createDataFrame(rows, "base double, w double, d double, s double, n int").select(
        "base",
        "s",
        price().alias("p"),
        price(w=half["w"]).alias("less_weather"),
        price(d=half["d"]).alias("less_demand"),
        price(s=half["s"]).alias("less_supply"),
        P.scarcity_multiplier("s").alias("scarcity"),
    )
    for row in df.collect():
        assert row.p >= 0.6375 * 0.88 * row.base * (1 - 1e-12)
        assert row.less_weather <= row.p * (1 + 1e-12)
        assert row.less_demand <= row.p * (1 + 1e-12)
        assert row.less_supply >= row.p * (1 - 1e-12)
        assert row.s < 0.3 or row.scarcity == 1.0


@pytest.mark.parametrize(
    "lat, month, temp, rain, score, bucket",
    [
        (20.2961, 6, 41.617, 0.1677, 0.8994, 0),
        (20.2961, 12, 21.617, 0.1677, 0.7876, 0),
        (0.0, 9, 35.0, 0.1, 0.94, 0),
        (90.0, 12, 10.0, 0.4, 0.4933, 2),
        (-90.0, 12, 10.0, 0.4, 0.4933, 2),
        (45.0, 1, 18.84, 0.25, 0.7012, 1),
    ],
)
def test_weather_golden(spark, lat, month, temp, rain, score, bucket):
    date = F.lit(dt.date(2024, month, 15))
    raw = S.raw_weather_score(S.temperature(F.lit(lat), date), S.rain_probability(F.lit(lat)))
    row = spark.range(1).select(
        S.temperature(F.lit(lat), date).alias("temp"),
        S.rain_probability(F.lit(lat)).alias("rain"),
        raw.alias("score"),
        S.condition_bucket(raw).alias("bucket"),
        S.weather_signal(F.lit(lat), date).alias("signal"),
    ).first()
    assert row.temp == pytest.approx(temp, abs=5e-4)
    assert row.rain == pytest.approx(rain, abs=5e-5)
    assert row.score == pytest.approx(score, abs=5e-5)
    assert row.bucket == bucket
    assert row.signal.condition == ["Sunny", "Partly Cloudy", "Overcast"][bucket]
    assert row.signal.score == round(score, 3)


def test_weather_inputs(spark):
    date = F.lit(dt.date(2024, 6, 15))
    df = spark.createDataFrame([(5.0, 0.9), (None, None)], "temp double, rain double").select(
        S.weather_signal(F.lit(10.0), date, observed_temp="temp", observed_rain="rain").alias("w"),
        S.weather_signal(F.lit(10.0), date).alias("plain"),
        S.weather_signal(F.lit(10.0), date, rain_noise=5.0, temp_noise=-500.0).alias("bad"),
    )
    observed, modelled = df.collect()
    assert observed.w.temperature == 5.0 and observed.w.precipitation == 90.0
    assert observed.w.score == round(0.1 * 0.6 + 5 / 30 * 0.4, 3)
    assert modelled.w == modelled.plain
    assert modelled.bad.score == 0.1


@pytest.mark.parametrize(
    "date, uplift, expected",
    [
        (dt.date(2024, 3, 4), 0.0, 0.4),  # Monday in March
        (dt.date(2024, 3, 8), 0.0, 0.7),  # Friday
        (dt.date(2024, 7, 7), 0.0, 1.0),  # Sunday in July
        (dt.date(2024, 12, 4), 0.0, 0.65),  # Wednesday in December
        (dt.date(2024, 1, 6), 0.0, 0.95),  # Saturday in January
        (dt.date(2024, 3, 4), 0.5, 0.9),
        (dt.date(2024, 7, 7), 0.5, 1.0),
        (dt.date(2024, 3, 4), None, 0.4),
    ],
)
def test_demand_golden(spark, date, uplift, expected):
    row = spark.range(1).select(
        S.demand_signal(F.lit(date), F.lit(uplift).cast("double")).alias("d")
    ).first()
    assert row.d == expected


def test_dates(spark):
    row = spark.range(1).select(
        S.date_text(S.date_ahead("2024-12-31", F.lit(1))).alias("next"),
        S.weekday_of(F.lit(dt.date(2024, 3, 4))).alias("monday"),
        S.date_ahead(None, F.lit(0)).alias("today"),
        F.current_date().alias("now"),
    ).first()
    assert row.next == "2025-01-01" and row.monday == 0 and row.today == row.now


def test_seed_tiers(spark):
    counts = hotels(spark).groupBy(P.price_tier("base_price").alias("t")).count().collect()
    assert {row.t: row["count"] for row in counts} == {"budget": 2, "mid": 7, "luxury": 11}
