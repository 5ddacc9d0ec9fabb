import datetime as dt
import os

import pytest
from data import HOTELS, hotels
from pyspark.sql import functions as F

from innsight.functions.pricing import dynamic_price
from innsight.sources.schemas import SIGNAL_STREAM
from innsight.sources.parts import PartTable
from innsight.streaming.demand import demand_windows
from innsight.streaming.reprice import reprice
from innsight.streaming.sinks import compact_updates, read_updated, run_append, run_update, update_table

EVENTS = "hotel_id long, event_time timestamp, value double"
KEYS = ["hotel_id", "window_start", "window_end"]


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute)


def add_file(spark, folder, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema=EVENTS):
    return spark.readStream.schema(schema).parquet(folder)


def totals(df):
    return {(r.hotel_id, r.window_start.hour): (r.events, r.total_value) for r in df.collect()}


@pytest.mark.parametrize("way", ["broadcast", "salted"])
def test_reprice_stream_equals_batch(spark, tmp_path, way, request):
    if way == "salted":
        request.getfixturevalue("salted")
    folder = str(tmp_path / "signals")
    rows = [
        (1 if i % 3 == 0 else i % 25, at(i % 24), 0.3 + i % 7 / 10, 0.5, i % 10 / 10, i % 91)
        for i in range(200)
    ]
    add_file(spark, folder, rows, SIGNAL_STREAM)
    known = hotels(spark)
    streamed = run_append(
        stream(spark, folder, SIGNAL_STREAM), "reprice", lambda batch: reprice(batch, known)
    )
    lost = streamed.where("price is null")
    assert lost.count() == sum(r[0] not in {h[0] for h in HOTELS} for r in rows) > 0
    streamed = streamed.where("price is not null")
    batch = spark.read.parquet(folder).join(hotels(spark), "hotel_id")
    expected = batch.select(
        "hotel_id",
        "event_time",
        "days_ahead",
        dynamic_price(
            "base_price", "weather_score", "demand_score", "supply_factor", "days_ahead"
        ).alias("price"),
    )
    found = streamed.select("hotel_id", "event_time", "days_ahead", "price")
    assert sorted(found.collect()) == sorted(expected.collect())
    assert found.count() > 150


def test_windows_over_several_batches(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    windows = None
    batches = [
        [(1, at(8, 10), 1.0), (2, at(8, 20), 2.0)],
        [(1, at(8, 50), 4.0), (1, at(9, 30), 8.0)],  # the first window grows
        [(1, at(12, 0), 16.0)],  # moves the watermark to 11:00
        [(1, at(8, 55), 32.0), (1, at(11, 30), 64.0)],  # too late; still open
    ]
    for rows in batches:
        add_file(spark, folder, rows)
        windows = demand_windows(stream(spark, folder), "1 hour", "1 hour")
        update_table(windows, out, checkpoint).awaitTermination()
    expected = {
        (1, 8): (2, 5.0),
        (2, 8): (1, 2.0),
        (1, 9): (1, 8.0),
        (1, 12): (1, 16.0),
        (1, 11): (1, 64.0),
    }
    assert totals(read_updated(spark, out, windows, KEYS)) == expected
    assert compact_updates(spark, out, KEYS) and not compact_updates(spark, out, KEYS)
    assert len(PartTable(spark, out).state().folders()) == 1
    assert totals(read_updated(spark, out, windows, KEYS)) == expected
    add_file(spark, folder, [(1, at(12, 30), 3.0)])  # and the stream goes on
    update_table(windows, out, checkpoint).awaitTermination()
    assert totals(read_updated(spark, out, windows, KEYS)) == expected | {(1, 12): (2, 19.0)}


def test_windows_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1 if i % 3 == 0 else i % 7, at(i % 24, i % 60), float(i)) for i in range(500)]
    add_file(spark, folder, rows)
    streamed = run_update(demand_windows(stream(spark, folder), "1 hour"), "demand", KEYS)
    batch = demand_windows(spark.read.parquet(folder), "1 hour")
    assert sorted(streamed.collect()) == sorted(batch.collect())
    assert batch.agg(F.sum("events")).first()[0] == 500


def test_no_input_yet(spark, tmp_path):
    (tmp_path / "none").mkdir()
    events = stream(spark, str(tmp_path / "none"))
    windows = demand_windows(events, "1 hour")
    counted = run_update(windows, "demand", KEYS)
    assert counted.columns == windows.columns and counted.count() == 0
    known = hotels(spark)
    signals = stream(spark, str(tmp_path / "none"), SIGNAL_STREAM)
    priced = run_append(signals, "reprice", lambda batch: reprice(batch, known))
    assert "price" in priced.columns and priced.count() == 0


@pytest.mark.parametrize("compact", ["never", "before", "after", "both"])
@pytest.mark.parametrize("lost", [[1], [0, 1]])
def test_batches_that_run_again_lose_nothing(spark, tmp_path, compact, lost):
    """The notes that batches are done get lost; the stream runs them again."""
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    windows = None
    for rows in ([(1, at(8), 10.0), (2, at(8), 20.0)], [(2, at(8, 5), 1.0)]):
        add_file(spark, folder, rows)
        windows = demand_windows(stream(spark, folder), "1 hour")
        update_table(windows, out, checkpoint).awaitTermination()
        if compact == "both":
            compact_updates(spark, out, KEYS)
    expected = {(1, 8): (1, 10.0), (2, 8): (2, 21.0)}
    assert totals(read_updated(spark, out, windows, KEYS)) == expected
    for batch in lost:
        os.remove(f"{checkpoint}/commits/{batch}")
    if compact in ("before", "both"):
        compact_updates(spark, out, KEYS)
    windows = demand_windows(stream(spark, folder), "1 hour")
    update_table(windows, out, checkpoint).awaitTermination()
    assert totals(read_updated(spark, out, windows, KEYS)) == expected
    if compact == "after":
        compact_updates(spark, out, KEYS)
    add_file(spark, folder, [(1, at(8, 30), 5.0)])
    windows = demand_windows(stream(spark, folder), "1 hour")
    update_table(windows, out, checkpoint).awaitTermination()
    assert totals(read_updated(spark, out, windows, KEYS)) == expected | {(1, 8): (2, 15.0)}
