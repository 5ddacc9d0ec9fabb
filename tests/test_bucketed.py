import random

import pytest
from pyspark.sql import functions as F

from innsight.operators.bucketed import open_bucketed, write_bucketed
from innsight.operators.latest import latest_reviews
from innsight.plans.history import price_statistics
from innsight.registry.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"  # no hotel is hot there
HOTELS = 300


def history(spark, hot):
    draw = random.Random(2)
    rows = []
    for i in range(3000):
        hotel = 7 if hot and i % 3 == 0 else draw.choice((None, *range(HOTELS + 20)))
        rows.append((hotel, i, draw.random() * 100, draw.random(), draw.random(), draw.random()))
    return spark.createDataFrame(
        rows,
        "hotel_id long, review_id long, price double, occupancy_rate double, weather_score double, demand_score double",
    ).withColumn("created_at", F.timestamp_seconds(F.col("review_id") % 97))


@pytest.fixture(params=[False, True], ids=["even", "hot"])
def stored(spark, tmp_path, request):
    df = history(spark, request.param)
    hotels = spark.range(HOTELS).select(F.col("id").alias("hotel_id"), (F.col("id") % 9).alias("city"))
    write_bucketed(df, str(tmp_path / "history"), "hotel_id", 6, ["created_at"])
    write_bucketed(hotels, str(tmp_path / "hotels"), "hotel_id", 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param, df, hotels, open_bucketed(spark, str(tmp_path / "history")), open_bucketed(spark, str(tmp_path / "hotels"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    # of a frame that has run both plans are shown
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_hot_keys_are_stored_apart(spark, stored):
    hot, df, _, table, _ = stored
    assert table.hot.count() == (df.where("hotel_id = 7").count() if hot else 0)
    assert table.cold.count() + table.hot.count() == 3000
    assert sorted(table.rows().collect(), key=repr) == sorted(df.collect(), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_moves_no_history_row(stored, how):
    hot, df, hotels, table, dimension = stored
    joined = table.lookup(dimension, how)
    expected = df.join(hotels, "hotel_id", how)
    assert joined.columns == expected.columns
    assert sorted(joined.collect(), key=repr) == sorted(expected.collect(), key=repr)
    assert "Exchange hashpartitioning" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
    with pytest.raises(ValueError):
        table.lookup(dimension, "full")


def test_groups_by_hotel_move_no_row(stored):
    hot, df, _, table, _ = stored
    stats = table.grouped(price_statistics)
    found = {r.hotel_id: r for r in stats.collect()}
    for r in price_statistics(df).collect():
        assert tuple(found.pop(r.hotel_id))[1:] == pytest.approx(tuple(r)[1:], abs=1e-9, nan_ok=True)
    assert not found
    # but for one combined row a task of each hot hotel
    assert plan_of(stats).count("Exchange hashpartitioning") == int(hot)
    newest = table.grouped(lambda rows: latest_reviews(rows, 3))
    assert sorted(newest.collect(), key=repr) == sorted(latest_reviews(df, 3).collect(), key=repr)
    assert plan_of(newest).count("Exchange hashpartitioning") == int(hot)


@pytest.mark.parametrize("name", ["bucketed_history_with_hotels", "bucketed_hotel_stats", "bucketed_latest_reviews"])
def test_registered_queries_move_no_row(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cold = [x for x in plan.splitlines() if "Bucketed: true" in x]
    assert cold and "Exchange hashpartitioning" not in plan


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "hotel_id long, price double")
    write_bucketed(none, str(tmp_path / "none"), "hotel_id", 4)
    table = open_bucketed(spark, str(tmp_path / "none"))
    assert table.rows().count() == 0 and table.lookup(table, "left_semi").count() == 0
    assert table.grouped(lambda df: df.groupBy("hotel_id").count()).count() == 0
