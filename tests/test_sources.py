import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from innsight.functions.geo import curve_key
from innsight.operators.radius import within_radius
from innsight.sources.schemas import TABLES
from innsight.sources.scratch import scratch_folder, stage_table
from innsight.sources.tables import (
    from_json_documents,
    keyed,
    load_table,
    to_json_documents,
    with_month,
    write_json,
    write_table,
)


def some_history(spark, n=600):
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).cast("long").alias("hotel_id"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 90).cast("int")).alias(
            "recorded_date"
        ),
        (F.col("id") * 1.5).alias("price"),
        F.lit(50.0).alias("occupancy_rate"),
        F.lit(0.5).alias("weather_score"),
        F.lit(0.4).alias("demand_score"),
    )


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_formats_keep_schema_and_rows(spark, tmp_path, format):
    df = some_history(spark)
    path = str(tmp_path / format)
    write_table(df, path, format=format)
    loaded = load_table(spark, "price_history", path, format)
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in TABLES["price_history"].schema]
    assert sorted(loaded.collect()) == sorted(df.collect())


def test_defaults(spark, tmp_path):
    path = str(tmp_path / "bookings")
    rows = [(1, 1, None, None), (2, 1, 3, "cancelled")]
    write_table(spark.createDataFrame(rows, "id long, hotel_id long, rooms int, status string"), path)
    loaded = load_table(spark, "bookings", path)
    found = {r.id: r for r in loaded.collect()}
    assert (found[1].rooms, found[1].status) == (1, "confirmed")
    assert (found[2].rooms, found[2].status) == (3, "cancelled")
    assert found[1].created_at is not None and found[1].guest_name is None
    hotel = TABLES["hotels"].schema
    path = str(tmp_path / "hotels")
    write_table(spark.createDataFrame([(1,)], "id long"), path)
    row = load_table(spark, "hotels", path).first()
    assert (row.amenities, row.rating, row.review_count) == ("[]", 4.0, 0)
    assert load_table(spark, "hotels", path).columns == hotel.names


def test_keyed_bookings(spark):
    rows = [(7, 1, "g", dt.date(2024, 3, 1), dt.datetime(2024, 2, 28, 23, 59))]
    df = spark.createDataFrame(
        rows, "id long, hotel_id long, guest_name string, check_in date, created_at timestamp"
    )
    row = keyed(df, "bookings").first()
    assert (row.booking_id, row.guest_id, row.lead_days) == (7, "g", 2)
    assert keyed(some_history(spark), "price_history").columns[0] == "history_id"


def test_write_replaces_and_partitions(spark, tmp_path):
    path = str(tmp_path / "history")
    write_table(some_history(spark, 10), path)
    df = with_month(some_history(spark), "recorded_date")
    write_table(df, path, "month_start", "hotel_id")
    assert len(glob.glob(f"{path}/month_start=*")) == 3
    # a few files per month, not one from every task
    assert len(glob.glob(f"{path}/*/*.parquet")) <= 8
    loaded = spark.read.parquet(path)
    assert loaded.count() == 600
    assert sorted(loaded.select(*df.columns).collect()) == sorted(df.collect())
    february = loaded.where("month_start = date'2024-02-01'")
    plan = february._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_start" in plan


def test_json_documents(spark, tmp_path):
    df = some_history(spark, 5).withColumn("price", F.when(F.col("id") != 2, F.col("price")))
    texts = [json.loads(r.document) for r in to_json_documents(df).collect()]
    assert sorted(t["id"] for t in texts) == [0, 1, 2, 3, 4]
    assert [t["price"] for t in texts if t["id"] == 2] == [None]
    assert sorted(from_json_documents(to_json_documents(df), df.schema).collect(), key=repr) == sorted(
        df.collect(), key=repr
    )
    path = str(tmp_path / "json")
    write_json(df, path)
    assert sorted(load_table(spark, "price_history", path, "json").collect(), key=repr) == sorted(
        df.collect(), key=repr
    )


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "history")
    write_table(some_history(spark), path)
    df = load_table(spark, "price_history", path).where("hotel_id = 3").select("price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hotel_id,3)" in plan and "ReadSchema: struct<hotel_id:bigint,price:double>" in plan


def test_scratch_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_folder(spark, "x").startswith(shared)
    assert scratch_folder(spark, "x") != scratch_folder(spark, "x")
    staged = stage_table(some_history(spark, 20), "history")
    assert staged.count() == 20
    assert all(name.split(":", 1)[-1].lstrip("/").startswith(shared.lstrip("/")) for name in staged.inputFiles())


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        scratch_folder(Session(), "x")


# --- layout by place ------------------------------------------------------------


def scattered_places(spark, n=40_000):
    """Over the whole earth, a third in one town; some without a place."""
    uniform = lambda seed, low, high: F.rand(seed) * (high - low) + low
    town = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.col("id").alias("hotel_id"),
        (F.col("id") % 5 + 1).cast("int").alias("star_rating"),
        F.when(F.col("id") % 101 != 0, F.when(town, uniform(1, 48.0, 48.4)).otherwise(uniform(2, -90, 90))).alias("lat"),
        F.when(town, uniform(3, 11.0, 11.6)).otherwise(uniform(4, -180, 180)).alias("lon"),
    )


def rows_scanned(df):
    """Rows that the scan of a plan without shuffles handed on."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_curve_keeps_near_places_together(spark):
    n = 1 << 16
    cells = spark.range(64 * 64).select(
        ((F.col("id") / 64).cast("int") * 180.0 / 64 - 90 + 0.01).alias("lat"),
        ((F.col("id") % 64) * 360.0 / 64 - 180 + 0.01).alias("lon"),
    )
    rows = cells.withColumn("key", curve_key("lat", "lon")).orderBy("key").collect()
    keys = [r.key for r in rows]
    assert len(set(keys)) == 64 * 64 and max(keys) < n * n
    for start in range(0, 64 * 64, 64):  # any 64 neighbours on the curve are a square
        some = rows[start : start + 64]
        assert max(r.lat for r in some) - min(r.lat for r in some) == pytest.approx(7 * 180 / 64)
        assert max(r.lon for r in some) - min(r.lon for r in some) == pytest.approx(7 * 360 / 64)
    for a, b in zip(rows, rows[1:]):  # each step of the curve leads to a cell beside
        assert abs(a.lat - b.lat) * 64 / 180 + abs(a.lon - b.lon) * 64 / 360 == pytest.approx(1)
    corner = [r.key for r in spark.sql("select 89.999D lat, 179.999D lon").select(curve_key("lat", "lon").alias("key")).collect()] * 2
    odd = spark.createDataFrame([(None, 1.0), (1.0, None), (95.0, 181.0), (90.0, 180.0)], "lat double, lon double")
    assert [r.key for r in odd.select(curve_key("lat", "lon").alias("key")).collect()] == [None, None, *corner]


@pytest.mark.parametrize("lat, lon, radius", [(10.0, 20.0, 300.0), (48.2, 11.3, 3.0), (5.0, 179.9, 400.0)])
def test_box_skips_files_of_a_table_laid_out_by_place(spark, tmp_path, lat, lon, radius):
    df = scattered_places(spark)
    near, by_id = str(tmp_path / "near"), str(tmp_path / "by_id")
    write_table(df, near, near=("lat", "lon"), files=32)
    df.repartition(32).write.parquet(by_id)
    found = [within_radius(spark.read.parquet(p), lat, lon, radius) for p in (near, by_id)]
    assert sorted(found[0].collect()) == sorted(found[1].collect()) and found[0].count() > 0
    read = [rows_scanned(f) for f in found]
    assert read[1] == 40_000 and read[0] <= 40_000 / 4
    sizes = [r["count"] for r in spark.read.parquet(near).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 24 and max(sizes) < 3 * 40_000 / 32  # the town is in many files
    assert spark.read.parquet(near).count() == 40_000
