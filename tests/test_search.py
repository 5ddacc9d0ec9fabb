import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from data import HOTELS, hotels
from pyspark.sql import functions as F

from innsight.functions.geo import distance_km
from innsight.operators.measured import signal_sums
from innsight.operators.radius import (
    candidates_of_points,
    grouped,
    shortlists,
    top_within_radius,
    top_within_radius_of_points,
    within_radius,
)
from innsight.plans.search import search_document, search_hotels

HERE = (20.2961, 85.8245)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()



def python_distance(lat_a, lon_a, lat_b, lon_b):
    a, b = math.radians(lat_a), math.radians(lat_b)
    cosine = math.cos(a) * math.cos(b) * math.cos(math.radians(lon_b - lon_a))
    cosine += math.sin(a) * math.sin(b)
    return math.acos(max(-1.0, min(1.0, cosine))) * 6371


def place_frame(spark, rows):
    return spark.createDataFrame(rows, "hotel_id long, star_rating int, lat double, lon double")


def point_frame(spark, rows):
    return spark.createDataFrame(rows, "point_id long, point_lat double, point_lon double")


def test_seed_radius(spark):
    rows = top_within_radius(hotels(spark), *HERE, 50.0).collect()
    assert [row.hotel_id for row in rows] == [1, 2, 3, 4, 5, 9]
    distances = [round(row.distance_km, 3) for row in rows]
    assert distances == [0.0, 2.162, 5.158, 5.283, 4.019, 17.832]
    far = hotels(spark).where("hotel_id in (6, 7, 8)").orderBy("hotel_id")
    found = far.select(distance_km(*HERE, "lat", "lon").alias("d")).collect()
    assert [round(row.d, 3) for row in found] == [55.223, 54.055, 56.285]


@pytest.mark.parametrize(
    "lat, lon, radius",
    [
        (20.0, 85.0, 500.0),
        (89.5, 10.0, 300.0),  # over the north pole
        (-90.0, 0.0, 1000.0),
        (10.0, 179.5, 400.0),  # over the 180th meridian
        (10.0, -179.5, 400.0),
        (60.0, 0.0, 5000.0),
        (0.0, 0.0, 21000.0),  # everything
        (0.0, 0.0, 0.0),
    ],
)
def test_box_loses_nothing(spark, lat, lon, radius):
    random.seed(7)
    rows = [(i, 3, random.uniform(-90, 90), random.uniform(-180, 180)) for i in range(2000)]
    rows += [(5000 + i, 3, lat, (lon + i * 360 / 50 + 180) % 360 - 180) for i in range(50)]
    rows += [(6000, 5, lat, lon), (6001, 4, lat, lon + 360)]
    found = {row.hotel_id for row in within_radius(place_frame(spark, rows), lat, lon, radius).collect()}
    distances = {row[0]: python_distance(lat, lon, row[2], row[3]) for row in rows}
    assert {i for i, d in distances.items() if d < radius - 1e-4} <= found
    assert found <= {i for i, d in distances.items() if d <= radius + 1e-4}
    assert 6000 in found


def brute_force(places, points, radius, limit):
    expected = {}
    for point_id, lat, lon in points:
        near = [
            (-stars, hotel_id)
            for hotel_id, stars, hlat, hlon in places
            if python_distance(lat, lon, hlat, hlon) <= radius
        ]
        for rank, (_, hotel_id) in enumerate(sorted(near)[:limit], 1):
            expected[point_id, rank] = hotel_id
    return expected


def scattered(seed):
    rng = random.Random(seed)
    places = [
        (i, rng.randint(3, 5), rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(600)
    ]
    # a third of the hotels in one town and many copies of one place
    places += [
        (1000 + i, rng.randint(3, 5), 48 + rng.gauss(0, 0.3), 11 + rng.gauss(0, 0.4))
        for i in range(400)
    ]
    places += [(3000 + i, 3 + i % 3, 48.137, 11.575) for i in range(200)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    points += [(100 + i, 48 + rng.gauss(0, 0.5), 11 + rng.gauss(0, 0.5)) for i in range(60)]
    points += [(300, 90.0, 0.0), (301, -90.0, 77.0), (302, 5.0, 180.0), (303, 5.0, -180.0)]
    points += [(400 + i, 48.137, 11.575) for i in range(30)]
    return places, points


@pytest.mark.parametrize("radius, limit", [(30.0, 20), (700.0, 5), (6000.0, 20), (1e-3, 3)])
def test_batch_equals_brute_force(spark, radius, limit):
    places, points = scattered(3)
    found = top_within_radius_of_points(
        place_frame(spark, places), point_frame(spark, points), radius, limit
    ).collect()
    actual = {(row.point_id, row.result_rank): row.hotel_id for row in found}
    assert actual == brute_force(places, points, radius, limit)


@pytest.mark.parametrize("radius, limit, split", [(30.0, 20, 4), (700.0, 5, 1), (1e-3, 3, 2), (6000.0, 2, 30)])
def test_split_cells_equal_brute_force(spark, radius, limit, split):
    places, points = scattered(4)
    found = top_within_radius_of_points(
        place_frame(spark, places), point_frame(spark, points), radius, limit, split
    ).collect()
    actual = {(row.point_id, row.result_rank): row.hotel_id for row in found}
    assert actual == brute_force(places, points, radius, limit)


def test_a_hundred_thousand_places_in_one_cell(spark):
    """The circle's edge runs through the town; a point meets a small part of it."""
    draw = np.random.default_rng(2)
    n, radius, limit = 100_000, 60.0, 20
    lat = 48.0 + draw.uniform(-0.05, 0.05, n)  # about 11 km, a cell has 20
    lon = 11.0 + draw.uniform(-0.07, 0.07, n)
    stars = draw.integers(1, 6, n)
    frame = pd.DataFrame({"hotel_id": np.arange(n), "star_rating": stars, "lat": lat, "lon": lon})
    places = spark.createDataFrame(frame).withColumn("star_rating", F.col("star_rating").cast("int"))
    # all of them, none of them, and a part of them within the circle
    points = [(0, 48.0, 11.0), (1, 47.0, 11.0)]
    points += [(2 + i, 48.0 + radius / 111.2 * math.cos(i), 11.0 + radius / 74.4 * math.sin(i)) for i in range(20)]
    asked = point_frame(spark, points)
    counts = candidates_of_points(places, asked, radius, limit).groupBy("point_id").count().collect()
    met = {r.point_id: r["count"] for r in counts}
    assert met[0] <= 30 * limit and met.get(1, 0) <= 30 * limit
    # along the edge: grows with the root of the number of places
    assert max(met.values()) < n / 10
    found = top_within_radius_of_points(places, asked, radius, limit).collect()
    actual = {}
    for r in sorted(found, key=lambda r: r.result_rank):
        actual.setdefault(r.point_id, []).append(r.hotel_id)
    a, b = np.radians(lat), np.radians(lon)
    for point_id, point_lat, point_lon in points:
        p, q = math.radians(point_lat), math.radians(point_lon)
        cosine = np.cos(p) * np.cos(a) * np.cos(b - q) + np.sin(p) * np.sin(a)
        near = np.flatnonzero(np.arccos(np.clip(cosine, -1, 1)) * 6371 <= radius)
        order = near[np.lexsort((near, -stars[near]))][:limit]
        assert actual.get(point_id, []) == order.tolist()


def test_points_meet_no_more_hotels_where_these_are_more(spark):
    """What a point meets follows the limit, not the number of hotels around it."""
    draw = np.random.default_rng(8)
    points = [(i, draw.uniform(-10, 10), draw.uniform(-10, 10)) for i in range(60)]
    longest = []
    for n in (4_000, 40_000):
        frame = pd.DataFrame({"hotel_id": np.arange(n), "stars": draw.integers(1, 6, n)})
        frame["lat"], frame["lon"] = draw.uniform(-20, 20, n), draw.uniform(-20, 20, n)
        places = spark.createDataFrame(frame).selectExpr("hotel_id", "int(stars) star_rating", "lat", "lon")
        groups = grouped(point_frame(spark, points), 700.0).select("gx", "gy", "gz").distinct()
        lists = shortlists(places, groups, 700.0, 20).groupBy("gx", "gy", "gz").count().collect()
        assert len(lists) == groups.count()
        longest.append(max(r["count"] for r in lists))
    assert 20 <= min(longest) and max(longest) <= 80


def test_points_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    places, points = scattered(7)
    monkeypatch.setattr("innsight.operators.radius.POINTS_PER_TASK", 10)
    one_file = point_frame(spark, points).coalesce(1)
    found = top_within_radius_of_points(place_frame(spark, places), one_file, 700.0, 5)
    dealt = f"hashpartitioning\\(point_id#\\d+L, {math.ceil(len(points) / 10)}\\), REPARTITION_BY_NUM"
    assert re.search(dealt, found._jdf.queryExecution().executedPlan().toString())


def test_long_lists_are_searched_singly(spark, monkeypatch):
    places, points = scattered(8)
    monkeypatch.setattr("innsight.operators.radius.SHORTLIST", 1)
    found = top_within_radius_of_points(place_frame(spark, places), point_frame(spark, points), 900.0, 3).collect()
    actual = {(row.point_id, row.result_rank): row.hotel_id for row in found}
    assert actual == brute_force(places, points, 900.0, 3)


def test_batch_of_nothing(spark):
    places, points = scattered(6)
    none = place_frame(spark, [])
    assert top_within_radius_of_points(none, point_frame(spark, points), 50.0).count() == 0
    assert top_within_radius_of_points(place_frame(spark, places), point_frame(spark, []), 50.0).count() == 0


def test_batch_salted_equals_brute_force(spark, salted):
    places, points = scattered(5)
    found = top_within_radius_of_points(
        place_frame(spark, places), point_frame(spark, points), 200.0, 20
    ).collect()
    actual = {(row.point_id, row.result_rank): row.hotel_id for row in found}
    assert actual == brute_force(places, points, 200.0, 20)


def test_search_prices_only_results(spark):
    stays = spark.sql(
        "select * from values (1L, date'2024-03-01', date'2024-04-06', 54, 'confirmed'), "
        "(8L, date'2024-03-01', date'2024-04-06', 9, 'confirmed') "
        "as t(hotel_id, check_in, check_out, rooms, status)"
    )
    calendar = spark.sql(
        "select * from values ('Avenford', date'2024-03-05', 0.3D), "
        "('Avenford', date'2024-03-05', 0.5D), ('Lindwell', date'2024-03-06', 0.5D) "
        "as t(city, date, uplift)"
    )
    found = search_hotels(
        hotels(spark), *HERE, 50.0, as_of="2024-03-04", bookings=stays, calendar=calendar
    )
    # nights come from stretches between changes, not from stays
    generated = [x for x in plan_of(found).splitlines() if "explode(sequence" in x]
    assert generated and not any("check_" in x for x in generated)
    rows = {row.hotel_id: row for row in found.collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 9}
    assert rows[1].supply_factor == 0.25 and rows[2].supply_factor == 1.0
    assert rows[1].demand_score == 0.9 and rows[9].demand_score == 0.4
    assert rows[1].available_rooms == 18 and rows[2].available_rooms == 40
    assert rows[1].price_factors.time_urgency == "High"
    row = rows[1]
    weather = 0.85 + row.weather.score * 0.35
    expected = 7600 * weather * (0.75 + 0.9**1.4 * 0.65) * (1 + 0.05 * 1.8) * 1.25
    assert row.optimized_price == pytest.approx(expected, abs=0.011)
    assert row.price_change_pct == round((row.optimized_price - 7600) / 7600 * 100, 1)


def test_measured_signals_replace_modelled_ones(spark):
    history = spark.sql(
        "select * from values (1L, date'2023-03-09', 0.5D, 0.2D), (1L, date'2022-03-10', 0.7D, 0.9D), "
        "(1L, date'2023-03-14', 0.9D, 0.4D), (2L, date'2023-07-04', 0.1D, 0.9D) "
        "as t(hotel_id, recorded_date, weather_score, demand_score)"
    )
    # a Tuesday in March: hotel 1 has both, hotel 2 the weekday only, hotel 3 nothing
    calendar = spark.sql("select 'Avenford' city, date'2024-03-05' date, 0.3D uplift")
    plain = {r.hotel_id: r for r in search_hotels(hotels(spark), *HERE, 50.0, as_of="2024-03-04").collect()}
    found = search_hotels(hotels(spark), *HERE, 50.0, as_of="2024-03-04", sums=signal_sums(history), calendar=calendar)
    rows = {r.hotel_id: r for r in found.collect()}
    assert rows[1].weather.score == 0.7 and rows[1].weather.condition == "Partly Cloudy"
    assert rows[1].demand_score == pytest.approx(0.7) and rows[2].demand_score == 1.0
    assert rows[2].weather == plain[2].weather and rows[3].weather == plain[3].weather
    assert rows[3].demand_score == pytest.approx(plain[3].demand_score + 0.3)
    assert "measured_weather" not in found.columns


def test_search_document(spark):
    document = search_document(search_hotels(hotels(spark), as_of="2024-03-04")).first()
    assert document.total == 6
    assert [row.hotel_id for row in document.hotels] == [1, 2, 3, 4, 5, 9]


def test_search_limit_and_ties(spark):
    rows = top_within_radius(hotels(spark), *HERE, 5000.0, limit=3).collect()
    stars = sorted(((-h[4], h[0]) for h in HOTELS))[:3]
    assert [row.hotel_id for row in rows] == [i for _, i in stars]
    empty = top_within_radius(hotels(spark).where(F.lit(False)), *HERE, 50.0)
    assert empty.count() == 0
