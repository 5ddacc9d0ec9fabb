import datetime as dt
import random

import pytest
from data import bookings, hotels
from pyspark.sql import functions as F

from innsight.operators.audit import audit_stored_tables, integrity_audit
from innsight.operators.latest import first_rows, latest_reviews
from innsight.operators.latest import first_rows
from innsight.operators.lookup import hot_keys, lookup, measured_bytes, salted_join
from innsight.operators.nights import booked_nights, supply_factors, with_supply


def day(text):
    return dt.date.fromisoformat(text)


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


# --- lookup -------------------------------------------------------------------


def skewed(spark):
    """A third of the rows on one key, most of those equal."""
    keys = [1] * 300 + list(range(2, 602)) + [None]
    fact = spark.createDataFrame([(k, "x") for k in keys], "k int, v string")
    dimension = spark.createDataFrame([(k, k * 10) for k in range(0, 400)], "k int, d int")
    return fact.repartition(6), dimension


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(spark, how):
    fact, dimension = skewed(spark)
    plain = lookup(fact, dimension, ["k"], how)
    salted = salted_join(fact, dimension, ["k"], how, ["v"], salts=5)
    assert plain.columns == salted.columns
    assert sorted(plain.collect(), key=repr) == sorted(salted.collect(), key=repr)


def test_lookup_chooses_by_measured_size(spark):
    fact, dimension = skewed(spark)
    assert "BroadcastHashJoin" in plan_of(lookup(fact, dimension, ["k"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beyond = plan_of(lookup(fact, dimension, ["k"], at_most_bytes=1 << 40))
        assert "BroadcastHashJoin" not in beyond and "SortMergeJoin" in beyond
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        lookup(fact, dimension, ["k"], "full")


def test_salt_spreads_a_hot_key(spark):
    hot = spark.range(0, 8000, 1, 8).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    joined = salted_join(hot, spark.createDataFrame([(1, 2)], "k int, d int"), ["k"], "left", ["v"], 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 8000 and max(sizes) < 8000 * 0.6


@pytest.fixture
def stored_history(spark, tmp_path):
    rows = [(1 if i % 3 else i % 50, f"2024-01-{i % 28 + 1:02d}", float(i), "wide") for i in range(900)]
    df = spark.createDataFrame(rows, "hotel_id int, recorded_date string, price double, wide string")
    df.withColumn("extra", F.create_map(F.lit("k"), "wide")).write.parquet(str(tmp_path / "h"))
    return spark.read.parquet(str(tmp_path / "h"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_both_ways_prune_and_filter_alike(spark, stored_history, salted, how):
    dimension = spark.createDataFrame([(i, i * 2) for i in range(0, 40, 2)], "hotel_id int, d int")

    def used(limit):
        spark.conf.set("innsight.lookup.broadcastBytes", limit)
        rows = lookup(stored_history.where("price > 10"), dimension, ["hotel_id"], how, salt=["recorded_date"])
        return rows.groupBy("hotel_id").agg(F.sum("price").alias("p"))

    plans = [plan_of(used(limit)) for limit in ("1000000", "-1")]
    for plan in plans:
        scan = next(x for x in plan.splitlines() if "ReadSchema" in x)
        assert "wide" not in scan and "extra" not in scan
        pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
        assert "GreaterThan(price,10.0)" in pushed
    assert sorted(used("1000000").collect()) == sorted(used("-1").collect())


def test_hot_keys_among_very_many(spark):
    """A sketch is much smaller than the number of keys, and misses none that is hot."""
    n = 400_000
    rows = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 40 == 1, 8).when(F.col("id") % 3000 == 2, 9)
        .otherwise(F.col("id")).alias("a"),
        F.when(F.col("id") % 1000 != 0, F.lit("x")).alias("b"),
    )
    assert len(hot_keys(rows, ["a", "b"])) == 2
    assert hot_keys(rows.where("a > 9"), ["a", "b"]) == [] == hot_keys(rows.limit(0), ["a"])
    assert hot_keys(rows.select(F.lit(None).cast("int").alias("a")), ["a"]) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_keys_of_two_types_and_two_columns(spark, how):
    fact = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 90).cast("int").alias("k"),
        F.when(F.col("id") % 7 != 0, F.lit("a")).alias("s"),
        "id",
    )
    dimension = spark.range(0, 80, 2).select(F.col("id").alias("k"), F.lit("a").alias("s"), (-F.col("id")).alias("d"))
    dimension = dimension.unionByName(spark.sql("select 5L k, 'a' s, 1L d union all select 5L, 'a', 2L"))
    plain = fact.join(dimension, ["k", "s"], how)
    salted = salted_join(fact, dimension, ["k", "s"], how, ["id"], 7)
    assert plain.columns == salted.columns
    assert sorted(plain.collect(), key=repr) == sorted(salted.collect(), key=repr)


def test_the_large_way_reads_the_fact_once_more(spark, stored_history, salted, monkeypatch):
    """Counts what a lookup runs while it plans: the measure of the dimension, and one
    pass over the keys of the fact."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, collect = [], DataFrame.collect  # first() collects, too

    def counted(self):
        plans.append(plan_of(self))
        return collect(self)

    monkeypatch.setattr(DataFrame, "collect", counted)
    dimension = spark.range(50).select(F.col("id").cast("int").alias("hotel_id"), F.lit(1).alias("d"))
    for limit, passes in (("1000000", 0), ("-1", 1)):
        spark.conf.set("innsight.lookup.broadcastBytes", limit)
        plans.clear()
        lookup(stored_history, dimension, ["hotel_id"], "inner", salt=["recorded_date"])
        scans = [x for p in plans for x in p.splitlines() if "ReadSchema" in x]
        assert len(scans) == passes and all("hotel_id" in s and "," not in s for s in scans)


def test_maps_pass_the_shuffled_way(spark, stored_history, salted):
    dimension = spark.createDataFrame([(1, 2)], "hotel_id int, d int")
    joined = lookup(stored_history, dimension, ["hotel_id"], "inner", salt=["recorded_date"])
    assert joined.where(F.col("extra")["k"] == "wide").count() == joined.count() > 0


def test_only_hot_keys_are_copied(spark, stored_history):
    one = spark.range(1).select(F.xxhash64(F.lit(1))).first()[0]
    assert hot_keys(stored_history, ["hotel_id"]) == [one]
    dimension = spark.createDataFrame([(i, i) for i in range(50)], "hotel_id int, d int")
    joined = salted_join(stored_history, dimension, ["hotel_id"], "inner", ["recorded_date"], 8)
    assert joined.count() == 900


@pytest.mark.parametrize("k", [3, 5000])
def test_first_rows_of_a_hot_key(spark, k):
    df = spark.range(0, 20_000, 1, 6).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 7).alias("key"), "id"
    )
    df = df.withColumn("m", F.create_map(F.lit("a"), "id"))
    got = first_rows(df, ["key"], [F.col("id").desc()], k, rank="n")
    assert got.columns == ["key", "id", "m", "n"]
    ids = [r["id"] for r in got.where("key = 1").orderBy("n").collect()]
    expected = [i for i in range(19_999, -1, -1) if i % 10 < 9 or i % 7 == 1][:k]
    assert ids == expected
    if k > 1000:
        sizes = df.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(64))).count().agg(F.max("count")).first()[0]
        assert sizes < 1000 and "rank_part" in plan_of(got)


def test_measured_bytes(spark):
    df = spark.createDataFrame([("ab", 1), (None, 2), ("cde", None)], "s string, n int")
    assert measured_bytes(df) == 3 * (8 + 4) + 5
    assert measured_bytes(df.where("n > 100")) == 0


# --- first rows ---------------------------------------------------------------


def test_first_rows_with_a_hot_key(spark):
    rows = spark.range(0, 9000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    top = first_rows(rows, ["k"], [F.col("id").desc()], 3, rank="n")
    # two limits: one before and one after the shuffle
    assert plan_of(top).count("WindowGroupLimit (") >= 2
    found = {}
    for row in top.collect():
        found.setdefault(row.k, []).append((row.n, row.id))
    expected = {}
    for i in range(8999, -1, -1):
        key = 0 if i % 3 == 0 else i % 50
        if len(expected.setdefault(key, [])) < 3:
            expected[key].append((len(expected[key]) + 1, i))
    assert {k: sorted(v) for k, v in found.items()} == expected


def test_latest_reviews_break_ties_by_id(spark):
    when = dt.datetime(2024, 1, 1)
    rows = [(i, 7, when) for i in range(10)] + [(50, 8, when)]
    reviews = spark.createDataFrame(rows, "review_id long, hotel_id long, created_at timestamp")
    found = latest_reviews(reviews, 5).where("hotel_id = 7").orderBy("review_rank").collect()
    assert [row.review_id for row in found] == [9, 8, 7, 6, 5]


# --- nights -------------------------------------------------------------------

STAYS = [
    (1, "a", 5, day("2024-12-30"), day("2025-01-02"), 2, 100.0, "confirmed"),
    (1, "b", 5, day("2024-12-31"), day("2025-01-01"), 50, 100.0, None),
    (1, "c", 5, day("2024-12-31"), day("2025-01-01"), 50, 100.0, "cancelled"),
    (1, "d", 5, day("2024-12-31"), day("2024-12-31"), 50, 100.0, "confirmed"),
    (1, "e", 5, None, day("2024-12-31"), 50, 100.0, "confirmed"),
    (1, "f", 5, day("2024-12-31"), day("2025-01-01"), 40, 100.0, "confirmed"),
    (2, "g", 5, day("2025-01-01"), day("2025-01-03"), 30, 100.0, "confirmed"),
    (99, "h", 5, day("2025-01-01"), day("2025-01-03"), 30, 100.0, "confirmed"),
]


def test_booked_nights_over_the_new_year(spark):
    found = {(r.hotel_id, str(r.night)): r.booked_rooms for r in booked_nights(bookings(spark, STAYS)).collect()}
    assert found == {
        (1, "2024-12-30"): 2,
        (1, "2024-12-31"): 92,
        (1, "2025-01-01"): 2,
        (2, "2025-01-01"): 30,
        (2, "2025-01-02"): 30,
        (99, "2025-01-01"): 30,
        (99, "2025-01-02"): 30,
    }


@pytest.mark.parametrize(
    "first, last", [("2024-12-31", "2025-01-01"), ("2025-01-02", "2025-01-02"), ("2030-01-01", "2030-01-09")]
)
def test_booked_nights_in_a_window(spark, first, last):
    stays = bookings(spark, STAYS)
    window = booked_nights(stays, first, last)
    whole = booked_nights(stays).where(F.col("night").between(first, last))
    assert sorted(window.collect(), key=repr) == sorted(whole.collect(), key=repr)


@pytest.mark.parametrize("window", [(None, None), ("2024-03-01", "2024-03-31"), ("2024-02-10", None), (None, "2024-02-10")])
def test_sweep_equals_counting_every_night(spark, window):
    """Long and short stays, a third of them in one hotel, some without rooms."""
    draw = random.Random(4)
    rows, expected = [], {}
    first, last = (w and day(w) for w in window)
    for i in range(1500):
        hotel = 1 if i % 3 == 0 else draw.choice((2, 3, 40, None))
        start = day("2024-01-01") + dt.timedelta(days=draw.randint(0, 100))
        length = draw.choice((-3, 0, 1, 1, 2, 7, 400))
        rooms, status = draw.choice((None, 0, 1, 5)), draw.choice((None, "confirmed", "cancelled"))
        rows.append((hotel, start, start + dt.timedelta(days=length), rooms, status))
        for k in range(length if status != "cancelled" else 0):
            night = start + dt.timedelta(days=k)
            if (not first or night >= first) and (not last or night <= last):
                at = (hotel, night)
                expected[at] = expected.get(at, 0) + (1 if rooms is None else rooms)
    stays = spark.createDataFrame(rows, "hotel_id long, check_in date, check_out date, rooms int, status string")
    nights = booked_nights(stays, *window)
    assert {(r.hotel_id, r.night): r.booked_rooms for r in nights.collect()} == expected
    assert nights.count() == len(expected)


def test_two_rows_a_booking_before_the_shuffle(spark):
    n = 3000
    stays = spark.range(n).select(
        (F.col("id") % 7).alias("hotel_id"),
        F.date_add(F.lit(day("2024-01-01")), F.col("id").cast("int") % 900).alias("check_in"),
        F.date_add(F.lit(day("2024-01-01")), F.col("id").cast("int") % 900 + 300).alias("check_out"),
        F.lit(1).alias("rooms"),
        F.lit("confirmed").alias("status"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        nights = booked_nights(stays)
        nights.collect()
        plan = nights._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sent = []

    def walk(node):
        if node.nodeName() == "Exchange":
            sent.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert len(sent) == 2 and max(sent) <= 2 * n


def test_supply_is_clamped(spark):
    rows = supply_factors(bookings(spark, STAYS), hotels(spark)).collect()
    share = {(r.hotel_id, str(r.night)): r.supply_factor for r in rows}
    assert share[1, "2024-12-31"] == 0.0  # 92 of 72 rooms
    assert share[2, "2025-01-01"] == 0.25
    assert all(hotel != 99 for hotel, _ in share)
    empty = hotels(spark).withColumn("total_rooms", F.lit(0))
    rows = supply_factors(bookings(spark, STAYS), empty).collect()
    assert rows and all(r.supply_factor == 0.0 and r.occupancy == 100.0 for r in rows)


def test_with_supply_fills_free_nights(spark):
    rows = spark.createDataFrame([(1, day("2024-12-30")), (5, day("2024-12-30"))], "hotel_id long, date date")
    supply = supply_factors(bookings(spark, STAYS), hotels(spark))
    found = {r.hotel_id: r.supply_factor for r in with_supply(rows, supply).collect()}
    assert found == {1: 1 - 2 / 72, 5: 1.0}


# --- audit --------------------------------------------------------------------


def test_audit_of_stored_tables(spark):
    stored = {
        "hotels": spark.createDataFrame(
            [(1, "a", "c", "d", 1.0, 1.0, 3, 5.0, 9), (1, None, "c", "d", 1.0, 1.0, 3, 5.0, None)],
            "id long, name string, city string, address string, lat double, lon double, "
            "star_rating int, base_price double, total_rooms int",
        ),
        "reviews": spark.createDataFrame(
            [(1, 1, 4.0), (2, 7, None), (3, 7, 4.0), (4, None, 4.0)],
            "id long, hotel_id long, rating double",
        ),
    }
    rows = audit_stored_tables(stored).where("violations > 0").collect()
    assert {(r.table_name, r.check_name, r.column_name): r.violations for r in rows} == {
        ("hotels", "missing", "name"): 1,
        ("hotels", "missing", "total_rooms"): 1,
        ("hotels", "repeated", "id"): 1,
        ("reviews", "missing", "hotel_id"): 1,
        ("reviews", "missing", "rating"): 1,
        ("reviews", "orphan", "hotel_id"): 2,
    }


def test_audit_reads_every_table_once(spark, tmp_path):
    """Against counts of each check by itself, over tables of several types and hot keys."""
    spark.range(400).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 60).cast("int").alias("a"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("x:"), F.col("id") % 5)).alias("b"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 13).alias("c"),
        F.date_add(F.lit(day("2024-01-01")), (F.col("id") % 9).cast("int")).alias("d"),
    ).write.parquet(str(tmp_path / "child"))
    spark.range(0, 50, 3).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("t")).write.parquet(
        str(tmp_path / "parent")
    )
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("child", "parent")}
    keys = [["a"], ["b"], ["a", "b"], ["b", "c"], ["a", "b", "c", "d"]]
    df = integrity_audit(
        tables,
        {"child": ["a", "b", "c"], "parent": ["k", "t"]},
        {"child": keys, "parent": [["k"], ["t"]]},
        {"child": {"a": ("parent", "k"), "c": ("child", "a")}, "parent": {"k": ("child", "a"), "t": ("child", "b")}},
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Join" in plan and "SortMergeJoin" not in plan
    found = {(r.table_name, r.check_name, r.column_name): r.violations for r in df.collect()}
    child, parent = tables["child"], tables["parent"]
    expected = {("child", "missing", c): child.where(F.col(c).isNull()).count() for c in "abc"}
    expected |= {("parent", "missing", c): parent.where(F.col(c).isNull()).count() for c in "kt"}
    for name, df, key in [("child", child, k) for k in keys] + [("parent", parent, ["k"]), ("parent", parent, ["t"])]:
        expected[name, "repeated", ",".join(key)] = df.count() - df.select(*key).distinct().count()
    for name, df, c, held in [
        ("child", child, "a", parent.select("k")),
        ("child", child, "c", child.select("a")),
        ("parent", parent, "k", child.select("a")),
        ("parent", parent, "t", child.select("b")),
    ]:
        known = {r[0] for r in held.collect()}
        expected[name, "orphan", c] = sum(r[0] is not None and r[0] not in known for r in df.select(c).collect())
    assert found == expected and sum(found.values()) > 1000
    none = integrity_audit({n: t.limit(0) for n, t in tables.items()}, {"child": ["a"]}, {"child": keys}, {})
    assert [r.violations for r in none.collect()] == [0] * 6


def test_missing_rooms_count_as_one_and_missing_totals_as_unknown(spark):
    stays = spark.createDataFrame(
        [(1, day("2024-01-01"), day("2024-01-02"), None, None), (2, day("2024-01-01"), day("2024-01-02"), 2, None),
         (3, day("2024-01-01"), day("2024-01-02"), 2, None)],
        "hotel_id long, check_in date, check_out date, rooms int, status string",
    )
    hotels = spark.createDataFrame([(1, 4), (2, None), (3, 0)], "hotel_id long, total_rooms int")
    rows = {r.hotel_id: r for r in supply_factors(stays, hotels).collect()}
    assert (rows[1].booked_rooms, rows[1].supply_factor, rows[1].occupancy) == (1, 0.75, 25.0)
    assert rows[2].supply_factor is None and rows[2].occupancy is None
    assert rows[3].supply_factor == 0.0


def test_scratch_tables_are_deleted(spark):
    import os

    from innsight.sources.scratch import scratch_tables

    with scratch_tables(spark, "gone") as stage:
        df = stage(spark.range(5))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))
