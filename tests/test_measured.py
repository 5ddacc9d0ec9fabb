import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from data import hotels
from pyspark.sql import functions as F

from innsight.operators.measured import (
    SignalSummary,
    measured_profiles,
    merged_sums,
    signal_sums,
    with_measured,
)
from innsight.plans.detail import hotel_detail
from innsight.plans.forecast import price_forecast
from innsight.plans.search import search_hotels
from innsight.registry.queries import QUERIES
from innsight.sources.runs import kept_run

START = dt.date(2023, 11, 20)
FOLDER = "/root/testdata/sf0.001"


def history_rows(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        day = START + dt.timedelta(days=draw.randint(0, 89))
        # a third on one hotel; some scores are missing or no numbers
        hotel = 1 if i % 3 == 0 else draw.randint(1, 20)
        weather = draw.choice((None, float("nan"), draw.randint(30, 100) / 100))
        rows.append((hotel, day, weather, draw.choice((None, draw.randint(20, 90) / 100))))
    return [*rows, (1, None, 0.5, 0.5), (None, START, 0.5, 0.5)]


def history(spark, rows):
    return spark.createDataFrame(
        rows, "hotel_id long, recorded_date date, weather_score double, demand_score double"
    )


def profiles(sums):
    return {r.hotel_id: (r.weather_by_month, r.demand_by_weekday) for r in measured_profiles(sums).collect()}


def expected_profiles(rows):
    seen = defaultdict(lambda: ({}, {}))
    cells = defaultdict(list)
    for hotel, day, weather, demand in rows:
        if day:
            cells[hotel, 0, day.month].append(weather)
            cells[hotel, 1, day.weekday()].append(demand)
    for (hotel, kind, slot), scores in cells.items():
        known = [Decimal(str(s)) for s in scores if s is not None and s == s]
        if known:
            mean = float(sum(known)) / len(known)
            seen[hotel][kind][slot] = pytest.approx(mean, abs=6e-10)
    return dict(seen)


def test_profiles_equal_means(spark):
    rows = history_rows(3000)
    assert profiles(signal_sums(history(spark, rows))) == expected_profiles(rows)


def test_folding_day_by_day_equals_recomputing(spark, tmp_path):
    rows = history_rows(1500)
    whole = history(spark, rows)
    summary = SignalSummary(spark, str(tmp_path / "sums"))
    assert summary.sums().count() == 0 and not summary.compact()
    days = [START + dt.timedelta(days=k) for k in range(90)]
    assert summary.fold_in(whole, days[0], days[79])
    late, *rest = days[80:]
    for day in [*rest[:4], late]:  # in any order
        assert summary.fold_in(whole, day)
    assert summary.compact()
    for day in rest[3:]:  # one of them again, after it was compacted
        assert summary.fold_in(whole, day) is (day != rest[3])
        assert not summary.fold_in(whole.limit(0), day)
    once = sorted(signal_sums(whole).collect(), key=repr)
    assert sorted(merged_sums(summary.sums()).collect(), key=repr) == once
    assert profiles(summary.sums()) == profiles(signal_sums(whole))
    assert summary.compact() and sorted(summary.sums().collect(), key=repr) == once
    assert len(summary.parts.state().folders()) == 1


def test_a_new_day_reads_that_day_only(spark, tmp_path):
    path = str(tmp_path / "history")
    history(spark, history_rows(500)).write.partitionBy("recorded_date").parquet(path)
    day = START + dt.timedelta(days=7)
    stored = spark.read.parquet(path)
    days = stored.where(F.col("recorded_date").between(F.lit(day), F.lit(day)))
    plan = signal_sums(days)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert str(day) in scan
    summary = SignalSummary(spark, str(tmp_path / "sums"))
    assert summary.fold_in(stored, day)
    assert summary.sums().agg(F.sum("weather_count")).first()[0] <= days.count()


def test_measured_columns(spark):
    rows = history_rows(400)
    expected = expected_profiles(rows)
    asked = [(h, START + dt.timedelta(days=k * 17)) for h in (1, 5, 77, None) for k in range(20)]
    frame = spark.createDataFrame(asked, "hotel_id long, date date")
    found = with_measured(frame, measured_profiles(signal_sums(history(spark, rows)))).collect()
    assert len(found) == len(asked)
    for r in found:
        weather, demand = expected.get(r.hotel_id, ({}, {})) if r.hotel_id else ({}, {})
        assert r.measured_weather == weather.get(r.date.month)
        assert r.measured_demand == demand.get(r.date.weekday())


def scans_of(df):
    """The locations that a plan reads, each as often as it is read."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.maxMetadataStringLength", "3000")
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset("spark.sql.maxMetadataStringLength")
    return [x.split("Location:")[1] for x in text.splitlines() if "Location:" in x]


@pytest.fixture
def stored(spark, tmp_path):
    """Hotels, bookings, history and kept sums as files, each named by its folder."""
    paths = {name: str(tmp_path / name) for name in ("hotels", "bookings", "reviews", "history", "calendar")}
    hotels(spark).write.parquet(paths["hotels"])
    spark.sql(
        "select 1L hotel_id, 7L booking_id, date'2024-02-19' check_in, date'2024-03-09' check_out, 8 rooms, 'confirmed' status"
    ).write.parquet(paths["bookings"])
    spark.sql(
        "select 1L hotel_id, 7L review_id, 'a' reviewer_name, 4D rating, 'c' comment, timestamp'2024-01-01' created_at"
    ).write.parquet(paths["reviews"])
    spark.sql("select 'Portmoor' city, date'2024-02-21' date, 0.3D uplift").write.parquet(paths["calendar"])
    history(spark, history_rows(2000)).write.parquet(paths["history"])
    frames = {name: spark.read.parquet(path) for name, path in paths.items()}
    summary = SignalSummary(spark, str(tmp_path / "sums"))
    summary.fold_in(frames["history"], START, START + dt.timedelta(days=200))
    return frames, summary.sums()


@pytest.mark.parametrize("plan", ["search", "forecast", "detail"])
def test_no_plan_reads_the_history_and_hotels_are_read_once(spark, stored, plan):
    frames, sums = stored
    asked = {"as_of": "2024-02-20", "bookings": frames["bookings"], "calendar": frames["calendar"]}
    run = {
        "search": lambda s: search_hotels(frames["hotels"], 20.2961, 85.8245, 500.0, sums=s, **asked),
        "forecast": lambda s: price_forecast(frames["hotels"], horizon=9, sums=s, **asked),
        "detail": lambda s: hotel_detail(frames["hotels"], frames["reviews"], sums=s, **asked),
    }[plan]
    kept = run(sums)
    scans = scans_of(kept)
    assert sum("/hotels" in s for s in scans) == (0 if plan == "search" else 1)
    assert not any("/history" in s for s in scans)
    # the sums and the bookings are read once, too
    assert sum("/sums/" in s for s in scans) == 1 and sum("/bookings" in s for s in scans) == 1
    if plan == "search":  # only what belongs to the hotels found, by filters of the scans
        own = [s for s in scans if "/sums/" in s or "/bookings" in s]
        assert all("In(hotel_id, [" in s for s in own)
        assert all("In(city, [" in s for s in scans if "/calendar" in s)
    fresh = run(signal_sums(frames["history"]))
    assert sorted(kept.collect(), key=repr) == sorted(fresh.collect(), key=repr)
    assert kept.count() > 5


@pytest.mark.parametrize("name", ["search_hotels", "price_forecast", "hotel_detail"])
def test_registered_queries_read_kept_sums(spark, name):
    scans = scans_of(QUERIES[name](spark, FOLDER))
    assert scans and not any("lineitem" in s for s in scans)
    assert sum("supplier" in s for s in scans) <= 1


def test_search_beyond_local_rows(spark, stored, monkeypatch):
    frames, sums = stored
    asked = {"as_of": "2024-02-20", "bookings": frames["bookings"], "calendar": frames["calendar"], "sums": sums}
    few = search_hotels(frames["hotels"], 20.2961, 85.8245, 500.0, **asked).collect()
    monkeypatch.setattr("innsight.operators.latest.LOCAL_ROWS", 3)
    monkeypatch.setattr("innsight.plans.search.LOCAL_ROWS", 3)
    many = search_hotels(frames["hotels"], 20.2961, 85.8245, 500.0, **asked).collect()
    assert sorted(few) == sorted(many) and len(few) > 5


def test_kept_runs(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "runs")
    spark.range(5).write.parquet(path)
    made = []

    def run(**parameters):
        df = spark.read.parquet(path)

        def build(folder):
            made.append(folder)
            df.write.parquet(folder)

        return spark.read.parquet(kept_run(spark, "copy", [df], build, root, **parameters)).count()

    assert run() == run() == 5 and len(made) == 1
    assert run(city="a") == 5 and len(made) == 2
    spark.range(2).write.mode("append").parquet(path)
    assert run() == 7 and len(made) == 3

    def broken(folder):
        spark.range(1).write.parquet(folder)
        raise RuntimeError("ended early")

    df = spark.read.parquet(path)
    with pytest.raises(RuntimeError):
        kept_run(spark, "half", [df], broken, root)
    kept = kept_run(spark, "half", [df], lambda folder: spark.range(3).write.parquet(folder), root)
    assert spark.read.parquet(kept).count() == 3

    def late(folder):
        other = kept_run(spark, "two", [df], lambda f: spark.range(1).write.parquet(f), root)
        assert other
        spark.range(2).write.parquet(folder)

    assert spark.read.parquet(kept_run(spark, "two", [df], late, root)).count() == 1
