import datetime as dt
import math
import random
import statistics

import pytest
from data import HOTELS, bookings, history, hotels
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from innsight.plans import bookings as B
from innsight.plans import detail, forecast, market, model
from innsight.plans import history as H
from innsight.functions import constants as C
from innsight.plans.optimisation import kept_optimisation, optimise


from innsight.sources.scratch import stage_table


def day(text):
    return dt.date.fromisoformat(text)


def python_corr(pairs):
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None]
    if len(pairs) < 2:
        return None
    xs, ys = zip(*pairs)
    if len(set(xs)) == 1 or len(set(ys)) == 1:
        return None
    return statistics.correlation(xs, ys)


# --- forecast -----------------------------------------------------------------


def test_forecast_of_all_hotels(spark):
    rows = forecast.price_forecast(hotels(spark).drop("total_rooms"), "2024-02-20").collect()
    assert len(rows) == 20 * 30
    first = [r for r in rows if r.hotel_id == 1]
    assert {str(r.date) for r in first} == {
        str(day("2024-02-20") + dt.timedelta(days=k)) for k in range(30)
    }
    by_day = {r.day_offset: r for r in first}
    # the same weekday and season, apart from urgency: 1.25 and 1.1
    assert by_day[0].raw_price / by_day[7].raw_price == pytest.approx(1.25 / 1.10, rel=1e-9)


def test_forecast_documents(spark):
    one = hotels(spark).where("hotel_id = 3")
    document = forecast.forecast_documents(forecast.price_forecast(one, "2024-02-20", 5)).first()
    assert document.hotel_name == "Hotel 3"
    assert [d.date for d in document.forecast] == [f"2024-02-2{k}" for k in range(5)]
    assert document.forecast[0].supply == 1.0


# --- detail -------------------------------------------------------------------


def test_detail_of_all_hotels(spark):
    base = hotels(spark).withColumn(
        "amenities",
        F.when(F.col("hotel_id") == 2, "[]")
        .when(F.col("hotel_id") == 3, "[broken")
        .when(F.col("hotel_id") != 4, F.col("amenities")),
    )
    rows = [(i, 1, f"r{i}", 4.0, "c", dt.datetime(2024, 1, 1 + i)) for i in range(8)]
    rows.append((90, 2, "only", 5.0, "c", dt.datetime(2024, 1, 1)))
    reviews = spark.createDataFrame(
        rows,
        "review_id long, hotel_id long, reviewer_name string, rating double, comment string, "
        "created_at timestamp",
    )
    found = {r.hotel_id: r for r in detail.hotel_detail(base, reviews, "2024-02-20").collect()}
    assert len(found) == 20
    assert [r.review_id for r in found[1].reviews] == [7, 6, 5, 4, 3]
    assert [r.reviewer_name for r in found[2].reviews] == ["only"]
    assert found[3].reviews == []
    assert found[1].amenities == ["Pool", "Spa"] and found[2].amenities == []
    assert found[3].amenities is None and found[4].amenities is None
    assert found[1].current_price > 0 and found[1].current_demand == 0.4
    unknown = detail.hotel_detail(base.where("hotel_id = 777"), reviews, "2024-02-20")
    assert unknown.count() == 0


# --- market -------------------------------------------------------------------


def test_market_of_seed_hotels(spark):
    rows = market.market_columns(hotels(spark), "2024-02-20")
    summary = market.market_summary(rows).first()
    assert (summary.budget, summary.mid, summary.luxury) == (2, 7, 11)
    assert summary.total_hotels == 20 and summary.total_revenue_estimate == 0.0
    supply = hotels(spark).select(
        "hotel_id", F.lit(day("2024-02-20")).alias("night"), F.lit(0.5).alias("supply_factor")
    )
    half = market.market_columns(hotels(spark), "2024-02-20", supply)
    top = market.top_hotels(half).collect()
    assert [r.hotel_id for r in top] == [10, 19, 13, 12, 15]
    assert [2 * r.revenue for r in top] == [7750000, 7700000, 6360000, 6105000, 6045000]
    document = market.market_document(half).first()
    assert document.avg_occupancy == 50.0
    assert [r.name for r in document.top_hotels] == [f"Hotel {i}" for i in (10, 19, 13, 12, 15)]
    assert document.price_distribution.asDict() == {"budget": 2, "mid": 7, "luxury": 11}


def test_empty_market_gives_zeros(spark):
    rows = market.market_columns(hotels(spark).where(F.lit(False)), "2024-02-20")
    assert market.market_summary(rows).first().asDict() == {
        "total_hotels": 0,
        "avg_occupancy": 0.0,
        "total_revenue_estimate": 0.0,
        "budget": 0,
        "mid": 0,
        "luxury": 0,
    }
    assert market.market_document(rows).first().top_hotels == []


# --- history ------------------------------------------------------------------


def random_history(n, seed=1, hot=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hotel = 1 if hot and i % 3 == 0 else rng.randint(1, 20)
        when = day("2023-01-01") + dt.timedelta(days=rng.randint(0, 400))
        weather, demand = rng.uniform(0.3, 1), rng.uniform(0.2, 0.9)
        price = 5000 * (0.85 + weather * 0.35) * (0.75 + demand * 0.6) + rng.gauss(0, 50)
        rows.append((hotel, when, price, rng.uniform(15, 85), weather, demand))
    return rows


def test_stats_with_hard_rows(spark):
    rows = [
        (1, day("2024-01-01"), 100.0, 50.0, 0.5, 0.2),
        (1, day("2024-01-02"), 110.0, 60.0, 0.5, None),
        (1, day("2024-01-03"), 130.0, 70.0, 0.5, 0.6),
        (1, day("2024-01-04"), None, 80.0, 0.5, 0.9),
        (1, day("2024-01-05"), 90.0, 80.0, 0.5, 0.4),
        (2, day("2024-01-01"), 100.0, 50.0, 0.5, 0.2),
        (404, day("2024-01-01"), 100.0, 50.0, 0.5, 0.2),
    ]
    found = {r.hotel_id: r for r in H.hotel_stats(history(spark, rows), hotels(spark)).collect()}
    assert set(found) == {1, 2}
    one, single = found[1], found[2]
    assert one.avg_price == 107.5 and one.peak_price == 130.0 and one.floor_price == 90.0
    assert one.price_volatility == pytest.approx(statistics.stdev([100, 110, 130, 90]))
    assert one.weather_price_correlation is None  # constant weather
    pairs = [(0.2, 100.0), (0.6, 130.0), (0.4, 90.0)]
    assert one.demand_price_correlation == pytest.approx(python_corr(pairs))
    assert single.price_volatility is None and single.demand_price_correlation is None
    assert H.hotel_stats(history(spark, rows), hotels(spark), "nowhere").count() == 0
    city = H.hotel_stats(history(spark, rows), hotels(spark), "Avenford").collect()
    assert {r.hotel_id for r in city} == {1, 2}


def test_stats_do_not_depend_on_partitions(spark):
    df = history(spark, random_history(3000))
    first = {r.hotel_id: r for r in H.hotel_stats(df, hotels(spark)).collect()}
    second = {r.hotel_id: r for r in H.hotel_stats(df.repartition(7), hotels(spark)).collect()}
    assert first.keys() == second.keys()
    for hotel, row in first.items():
        for name, value in row.asDict().items():
            assert second[hotel][name] == pytest.approx(value, rel=1e-9)


def test_patterns(spark):
    rows = random_history(2000)
    df = history(spark, rows)
    weekly = {r.weekday: r.avg_demand for r in H.weekly_pattern(df).collect()}
    for weekday in range(7):
        values = [r[5] for r in rows if r[1].weekday() == weekday]
        assert weekly[weekday] == pytest.approx(statistics.fmean(values))
    ranks = {r.weekday: r.demand_rank for r in H.peak_days(df).collect()}
    assert [d for d, _ in sorted(ranks.items(), key=lambda x: x[1])] == sorted(
        weekly, key=lambda d: -weekly[d]
    )
    overall = statistics.fmean(r[5] for r in rows)
    for row in H.monthly_index(df).collect():
        values = [r[5] for r in rows if r[1].month == row.month]
        assert row.avg_demand == pytest.approx(statistics.fmean(values))
        assert row.demand_index == pytest.approx(statistics.fmean(values) / overall)
    summary = H.run_summary(df).first()
    assert (summary.records_processed, summary.hotels_analyzed) == (2000, len({r[0] for r in rows}))
    empty = H.run_summary(df.where(F.lit(False))).first()
    assert (empty.records_processed, empty.hotels_analyzed) == (0, 0)


def test_weather_lag_equals_brute_force(spark):
    rows = random_history(1500)
    found = {r.hotel_id: r for r in H.weather_lag(history(spark, rows)).collect()}
    days = {}
    for hotel, when, _, _, weather, demand in rows:
        days.setdefault(hotel, {}).setdefault(when, []).append((weather, demand))
    for hotel, by_day in days.items():
        series = [
            (statistics.fmean(w for w, _ in v), statistics.fmean(d for _, d in v))
            for _, v in sorted(by_day.items())
        ]
        pairs = [
            (statistics.fmean(w for w, _ in series[max(0, i - 2) : i + 1]), series[i][1])
            for i in range(len(series))
        ]
        assert found[hotel].days == len(series)
        assert found[hotel].weather_demand_correlation == pytest.approx(python_corr(pairs))


@pytest.mark.parametrize("way", ["broadcast", "salted"])
def test_competitor_gap_equals_brute_force(spark, way, request):
    if way == "salted":
        request.getfixturevalue("salted")
    rows = random_history(1500)
    cities = {r.hotel_id: r.city for r in hotels(spark).collect()}
    months = {}
    for hotel, when, price, *_ in rows:
        months.setdefault((hotel, when.replace(day=1)), []).append(price)
    means = {key: statistics.fmean(values) for key, values in months.items()}
    found = H.competitor_gap(history(spark, rows), hotels(spark)).collect()
    assert {(r.hotel_id, r.month_start) for r in found} == set(means)
    for row in found:
        others = [
            v
            for (hotel, month), v in means.items()
            if month == row.month_start and hotel != row.hotel_id and cities[hotel] == row.city
        ]
        if others:
            assert row.competitor_price == pytest.approx(statistics.fmean(others))
        else:
            assert row.competitor_price is None and row.price_gap is None


# --- bookings -----------------------------------------------------------------


def random_bookings(n, seed=2):
    rng = random.Random(seed)
    start = day("2024-01-01")
    return [
        (
            1 if i % 3 == 0 else rng.randint(1, 20),
            f"g{rng.randint(1, 40)}",
            rng.choice([-1, 0, 2, 3, 7, 8, 30, 59, 60, 90]),
            start,
            start + dt.timedelta(days=2),
            rng.randint(1, 4),
            float(rng.randint(50, 900)),
            rng.choice(["confirmed", "confirmed", "cancelled"]),
        )
        for i in range(n)
    ]


def band(days):
    if days <= 2:
        return "last_minute"
    if days <= 7:
        return "week"
    return "early_bird" if days >= 60 else "standard"


def active_rows(rows):
    return [r for r in rows if r[7] != "cancelled"]


def test_segments(spark):
    rows = random_bookings(900)
    found = {r.segment: r for r in B.segments(bookings(spark, rows)).collect()}
    rows = active_rows(rows)
    assert sum(r.share_pct for r in found.values()) == pytest.approx(100)
    for name, row in found.items():
        own = [r for r in rows if band(r[2]) == name]
        assert row.bookings == len(own)
        assert row.avg_lead_days == pytest.approx(statistics.fmean(r[2] for r in own))
        slope = statistics.linear_regression(
            [math.log(r[6]) for r in own], [math.log(r[5]) for r in own]
        ).slope
        assert row.price_elasticity == pytest.approx(slope)


def test_free_booking_has_no_elasticity(spark):
    rows = [(1, "a", 1, day("2024-01-01"), day("2024-01-02"), 1, 0.0, "confirmed")] * 3
    row = B.segments(bookings(spark, rows)).first()
    assert row.price_elasticity is None and row.avg_price == 0.0


def test_overbooking_and_guest_value(spark):
    rows = random_bookings(600)
    rows.append((77, "z", 1, day("2024-01-01"), day("2024-01-02"), 1, 5.0, "cancelled"))
    df = bookings(spark, rows)
    found = {r.hotel_id: r for r in B.overbooking(df).collect()}
    own = [r[7] == "cancelled" for r in rows if r[0] == 1]
    c = sum(own) / len(own)
    assert found[1].cancelled_share == pytest.approx(c)
    assert found[1].overbooking_rate == pytest.approx(c / (1 - c))
    assert found[77].cancelled_share == 1.0 and found[77].overbooking_rate is None
    guests = {}
    for r in active_rows(rows):
        guests.setdefault(r[1], []).append(r)
    spend = {True: [], False: []}
    for stays in guests.values():
        spend[any(r[2] >= 60 for r in stays)].append(sum(r[6] for r in stays))
    value = {r.early_bird: r for r in B.early_bird_value(df).collect()}
    for early, sums in spend.items():
        if sums:
            assert value[early].guests == len(sums)
            assert value[early].avg_spend == pytest.approx(statistics.fmean(sums))


def test_bookings_without_guest_are_guests_of_their_own(spark):
    stay = (1, None, 70, day("2024-01-01"), day("2024-01-02"), 1, 10.0, None)
    row = B.early_bird_value(bookings(spark, [stay, stay, (*stay[:7], "cancelled")])).first()
    assert (row.guests, row.avg_spend, row.avg_bookings) == (2, 10.0, 1.0)


def test_recommendations(spark):
    rows, stays = random_history(1200), random_bookings(600)
    found = {
        r.recommendation: r
        for r in B.recommendations(history(spark, rows), bookings(spark, stays)).collect()
    }
    assert set(found) == {
        "weekend_surge",
        "weather_linked",
        "early_bird_discount",
        "last_minute_premium",
    }
    weekend = [r[2] for r in rows if r[1].weekday() >= 4]
    other = [r[2] for r in rows if r[1].weekday() < 4]
    row = found["weekend_surge"]
    mean = statistics.fmean(weekend)
    assert row.records == len(weekend)
    assert row.uplift_pct == pytest.approx((mean / statistics.fmean(other) - 1) * 100)
    error = statistics.stdev(weekend) / math.sqrt(len(weekend)) / mean
    assert row.confidence == pytest.approx(1 - error)
    late = [r[6] for r in active_rows(stays) if r[2] <= 2]
    standard = [r[6] for r in active_rows(stays) if 7 < r[2] < 60]
    row = found["last_minute_premium"]
    assert row.uplift_pct == pytest.approx(
        (statistics.fmean(late) / statistics.fmean(standard) - 1) * 100
    )
    empty = B.recommendations(
        history(spark, rows).where(F.lit(False)), bookings(spark, stays).where(F.lit(False))
    ).collect()
    assert len(empty) == 4 and all(r.uplift_pct is None and r.records == 0 for r in empty)


def test_correlations(spark):
    rows, stays = random_history(800), random_bookings(300)
    found = {
        r.factor: r.correlation
        for r in H.correlations(history(spark, rows), bookings(spark, stays)).collect()
    }
    assert found["supply_vs_price"] == pytest.approx(python_corr([(-r[3], r[2]) for r in rows]))
    assert found["demand_vs_price"] == pytest.approx(python_corr([(r[5], r[2]) for r in rows]))
    assert found["lead_time_vs_price"] == pytest.approx(python_corr(
        [(r[2], r[6]) for r in active_rows(stays)]
    ))


# --- model --------------------------------------------------------------------


def test_split_does_not_depend_on_partitions(spark):
    df = history(spark, random_history(4000))
    first = sorted(df.where(model.in_training()).collect())
    second = sorted(df.repartition(7).where(model.in_training()).collect())
    assert first == second and 0.77 < len(first) / 4000 < 0.83


def test_model_and_its_quality(spark):
    rows = random_history(3000) + [(1, day("2024-01-01"), 5000.0, None, 0.5, 0.5)]
    features = model.feature_table(history(spark, rows), hotels(spark))
    assert features.count() == 3001
    fitted = model.train_price_model(features, numTrees=10)
    nodes = model.price_forest(spark, fitted)
    predictions = model.predict(nodes, features.where(~model.in_training()))
    quality = model.evaluate(predictions).first()
    evaluator = RegressionEvaluator(labelCol="price_ratio")
    for metric in ("rmse", "r2"):
        expected = evaluator.evaluate(predictions, {evaluator.metricName: metric})
        assert quality[metric] == pytest.approx(expected)
    assert quality.r2 > 0.4
    scored = model.predict(nodes, features)
    adjustment = model.price_adjustment(scored, ["hotel_id"]).collect()
    assert sum(r.records for r in adjustment) == 3000
    changes = {}
    for row in scored.collect():
        changes.setdefault(row.hotel_id, []).append(row.prediction / row.price_ratio)
    for row in adjustment:
        expected = (statistics.fmean(changes[row.hotel_id]) - 1) * 100
        assert row.adjustment_pct == pytest.approx(expected)


def test_plain_prediction_reads_the_rows_twice(spark, tmp_path):
    """The means by hotel and the overall one come from one pass; the rows are the other."""
    path = str(tmp_path / "history")
    history(spark, random_history(600) + [(4, day("2024-01-01"), 5000.0, 50.0, 0.5, 0.5)]).write.parquet(path)
    features = model.feature_table(spark.read.parquet(path), hotels(spark))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = model.mean_ratio_prediction(features)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("FileScan parquet") == 2
    ratios = {}
    for row in features.where(model.in_training()).collect():
        ratios.setdefault(row.hotel_id, []).append(row.price_ratio)
    overall = statistics.fmean([r for own in ratios.values() for r in own])
    for row in found.collect():
        own = ratios.get(row.hotel_id)
        assert row.prediction == pytest.approx(statistics.fmean(own) if own else overall)


@pytest.mark.parametrize("trees, depth", [(10, 5), (3, 1), (4, 9), (1, 5)])
def test_nodes_predict_as_the_model_does(spark, trees, depth):
    """On every row, held out or not, and with values on the thresholds themselves."""
    rows = random_history(3000) + [(1, day("2024-01-01"), 5000.0, None, 0.5, 0.5)]
    features = model.feature_table(history(spark, rows), hotels(spark)).withColumn("row", F.monotonically_increasing_id())
    features = stage_table(features, "features")
    fitted = model.train_price_model(features, numTrees=trees, maxDepth=depth)
    nodes = model.price_forest(spark, fitted)
    assert nodes.select("tree").distinct().count() == trees
    assert nodes.where("node = 0").count() == trees and nodes.count() <= trees * 2 ** (depth + 1)
    edges = nodes.where("left >= 0 and feature = 0").select("threshold").distinct()
    edges = edges.select(F.col("threshold").alias("weather_score"), F.lit(0.5).alias("demand_score"))
    edges = edges.withColumns({c: F.lit(0.4) for c in C.FEATURES if c not in edges.columns} | {C.LABEL: F.lit(1.0), "row": -F.monotonically_increasing_id() - 1})
    both = features.select(*C.FEATURES, C.LABEL, "row").unionByName(edges.select(*C.FEATURES, C.LABEL, "row"))
    own = {r["row"]: r.prediction for r in model.predict(nodes, both).collect()}
    theirs = {r["row"]: r.prediction for r in fitted.transform(model.complete(both)).collect()}
    assert len(own) >= 3000 and own == pytest.approx(theirs, abs=1e-9)


def test_layout_grows_with_the_rows():
    assert [model.layout_of(n) for n in (0, 1, 200, 50_000, 5 * 10**12)] == [1, 1, 1, 16, 158114]


def test_one_kept_run_serves_all(spark, tmp_path, monkeypatch):
    paths = [str(tmp_path / name) for name in ("history", "hotels", "runs")]
    history(spark, random_history(900)).write.parquet(paths[0])
    hotels(spark).write.parquet(paths[1])
    runs, train = [], model.train_price_model

    def counted(*args, **named):
        runs.append(named)
        return train(*args, **named)

    monkeypatch.setattr("innsight.plans.optimisation.train_price_model", counted)

    def job(**named):
        stored = [spark.read.parquet(p) for p in paths[:2]]
        return kept_optimisation(*stored, stored, root=paths[2], **named)

    first, second = job(numTrees=3), job(numTrees=3)
    fresh = optimise(spark.read.parquet(paths[0]), spark.read.parquet(paths[1]), numTrees=3)
    assert len(runs) == 2  # one kept, one that was asked for afresh
    for name in ("summary", "stats", "nodes", "overall", "quality", "adjustments"):
        kept = [sorted(getattr(j, name).collect(), key=repr) for j in (first, second)]
        assert kept[0] == kept[1]
        found = sorted(getattr(fresh, name).collect(), key=repr)
        assert len(found) == len(kept[0]) and [tuple(r)[:1] for r in found] == [tuple(r)[:1] for r in kept[0]]
    assert job(numTrees=3, city="nowhere").nodes is None and len(runs) == 2
    assert job(numTrees=3, city="Portmoor").stats.count() == 3 and len(runs) == 3
    history(spark, random_history(9, seed=5)).write.mode("append").parquet(paths[0])
    assert job(numTrees=3).summary.first().records_processed == 909 and len(runs) == 4
    with pytest.raises(ValueError):
        kept_optimisation(history(spark, []), hotels(spark), [history(spark, [])])


def test_layout_decides_on_the_model_not_the_partitions(spark):
    features = model.feature_table(history(spark, random_history(1200)), hotels(spark))
    texts = set()
    for frame in (features.coalesce(1), features.repartition(7), features.orderBy("price")):
        fitted = model.train_price_model(frame, partitions=5, numTrees=6)
        texts.add(fitted.stages[-1].toDebugString.split("\n", 1)[1])
    assert len(texts) == 1


def test_training_leaves_no_folder(spark, tmp_path):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    optimise(history(spark, random_history(300)), hotels(spark), numTrees=2).overall.collect()
    assert set(os.listdir(shared)) == before


def test_kept_job_reads_stored_features_and_scores_once(spark, tmp_path):
    """Results that are all read share one stored feature table and one scoring."""
    kept = []

    def keep(df):
        path = str(tmp_path / f"kept{len(kept)}")
        df.write.parquet(path)
        kept.append(path)
        return spark.read.parquet(path)

    df = history(spark, random_history(900))
    stored, fresh = optimise(df, hotels(spark), keep=keep, numTrees=3), optimise(df, hotels(spark), numTrees=3)
    assert len(kept) == 2
    for name in ("overall", "quality", "adjustments", "stats", "summary"):
        shown, expected = getattr(stored, name), getattr(fresh, name)
        part = kept[0] if name in ("stats", "summary") else kept[1]
        assert {f.removeprefix("file://").rsplit("/", 1)[0] for f in shown.inputFiles()} == {part}
        rows = [sorted(d.collect(), key=repr) for d in (shown, expected)]
        assert len(rows[0]) == len(rows[1])
        for row, other in zip(*rows):
            for value, same in zip(row, other):
                assert value == (same if isinstance(same, str) else pytest.approx(same, rel=1e-9))
    marked = spark.read.parquet(kept[0])
    assert marked.where(F.col(model.CHOSEN) != model.in_training()).isEmpty()
    rows = model.complete(marked.where(~F.col(model.CHOSEN))).count()
    assert spark.read.parquet(kept[1]).count() == rows == stored.overall.first().records


def test_optimisation_job(spark):
    df = history(spark, random_history(1500))
    result = optimise(df, hotels(spark), numTrees=5)
    stats = {r.hotel_id: r.avg_price for r in result.stats.collect()}
    direct = {r.hotel_id: r.avg_price for r in H.hotel_stats(df, hotels(spark)).collect()}
    assert stats == pytest.approx(direct)
    assert {r.city for r in result.quality.collect()} <= {row[1] for row in HOTELS}
    held_out = df.where(~model.in_training()).select("hotel_id").distinct().count()
    assert result.adjustments.count() == held_out <= len(stats)
    overall = result.overall.first()
    assert overall.records == sum(r.records for r in result.quality.collect())
    assert overall.rmse > 0 and overall.r2 < 1
    assert result.summary.first().records_processed == 1500
    one = optimise(df, hotels(spark), "Portmoor", numTrees=5)
    assert {r.hotel_id for r in one.stats.collect()} <= {6, 7, 8}
    none = optimise(df, hotels(spark), "nowhere")
    assert none.nodes is None and none.stats.count() == 0
    assert none.summary.first().records_processed == 0
