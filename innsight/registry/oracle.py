"""The registered queries as SQL for DuckDB, over the same test tables."""

from __future__ import annotations

import re

# --- formulas as SQL text -----------------------------------------------------


def _rounded(value: str, digits: int, name: str | None = None) -> str:
    """Rounded, without negative zero."""
    return f"round({value}, {digits}) + 0e0 AS {name or value}"


def _significant(value: str, name: str | None = None) -> str:
    return f"CAST(CAST({value} AS FLOAT) AS DOUBLE) AS {name or value}"


def _day(value: str, name: str | None = None) -> str:
    return f"strftime({value}, '%Y-%m-%d') AS {name or value}"


def _moment(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S.%f') AS {value}"


def _weather_multiplier(w: str) -> str:
    return f"(0.85e0 + {w} * 0.35e0)"


def _demand_multiplier(d: str) -> str:
    return f"(0.75e0 + pow({d}, 1.4e0) * 0.65e0)"


def _scarcity(s: str) -> str:
    return f"(1e0 + greatest(0e0, (0.3e0 - {s}) * 1.8e0))"


def _urgency(n: str) -> str:
    return (
        f"(CASE WHEN {n} <= 2 THEN 1.25e0 WHEN {n} <= 7 THEN 1.1e0 "
        f"WHEN {n} >= 60 THEN 0.88e0 ELSE 1e0 END)"
    )


def _urgency_label(n: str) -> str:
    return f"(CASE WHEN {n} <= 2 THEN 'High' WHEN {n} <= 7 THEN 'Medium' ELSE 'Low' END)"


def _price(base: str, w: str, d: str, s: str, n: str) -> str:
    return (
        f"{base} * {_weather_multiplier(w)} * {_demand_multiplier(d)} "
        f"* {_scarcity(s)} * {_urgency(n)}"
    )


def _tier(base: str) -> str:
    return (
        f"(CASE WHEN {base} < 5000e0 THEN 'budget' WHEN {base} < 12000e0 THEN 'mid' "
        "ELSE 'luxury' END)"
    )


def _distance(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    return (
        "acos(greatest(-1e0, least(1e0, "
        f"cos(radians({lat_a})) * cos(radians({lat_b})) * cos(radians({lon_b} - {lon_a})) "
        f"+ sin(radians({lat_a})) * sin(radians({lat_b}))))) * 6371e0"
    )


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0e0)"


def _demand(date: str, uplift: str) -> str:
    """Demand of rows joined with measured_demand d."""
    return (
        f"coalesce(round(greatest(0.1e0, least(1e0, d.measured + coalesce({uplift}, 0e0))), 9), "
        f"{_modelled_demand(date, uplift)})"
    )


def _measured_demand(rows: str) -> str:
    """The join that ``_demand`` needs."""
    return (
        f"LEFT JOIN measured_demand d "
        f"ON d.hotel_id = {rows}.hotel_id AND d.weekday = isodow({rows}.date) - 1"
    )


def _modelled_demand(date: str, uplift: str) -> str:
    return (
        "round(greatest(0.1e0, least(1e0, 0.3e0 "
        f"+ (CASE WHEN isodow({date}) >= 5 THEN 0.3e0 ELSE 0e0 END) "
        f"+ (CASE WHEN month({date}) IN (6, 7, 8) THEN 0.4e0 "
        f"WHEN month({date}) IN (12, 1) THEN 0.35e0 ELSE 0.1e0 END) "
        f"+ coalesce({uplift}, 0e0))), 3)"
    )


_CONDITION = (
    "['Sunny', 'Partly Cloudy', 'Overcast', 'Light Rain', 'Clear Skies']"
    "[CAST(trunc((1e0 - raw_score) * 4e0) AS INTEGER) + 1]"
)

_IN_TRAINING = (
    "(('0x' || substr(md5(hotel_id || '|' || strftime(recorded_date, '%Y-%m-%d') || '|' "
    "|| CAST(floor(price * 100e0) AS BIGINT)), 1, 7))::BIGINT % 100 < 80)"
)

# The dates and places of queries.py
_AS_OF = "DATE '1998-06-01'"
_UNTIL = "DATE '1998-06-30'"
_CITY = "'NATION_3'"
_POINT = ("-45e0", "-143e0")
_SEARCH_POINT = ("20.2961e0", "85.8245e0")
_RADIUS = "5000e0"
_BATCH_RADIUS = "1000e0"

# --- views --------------------------------------------------------------------

_BASE = "CAST(3000 + ({key} * 7919) % 42000 AS DOUBLE)"
_SUPPLIERS = "(SELECT count(*) FROM supplier)"


def _weather_view(rows: str) -> str:
    """Rows with hotel_id, lat and date, plus the weather: measured, or else modelled."""
    return f"""
    SELECT *, coalesce(bounded, round(modelled, 3)) AS weather_score, {_CONDITION} AS condition
    FROM (SELECT *, greatest(0.1e0, least(1e0, measured)) AS bounded,
                 coalesce(greatest(0.1e0, least(1e0, measured)), modelled) AS raw_score
          FROM (SELECT *, greatest(0.1e0, least(1e0, (1e0 - rain) * 0.6e0
                           + least(temp, 30e0) / 30e0 * 0.4e0)) AS modelled
                FROM (SELECT r.*, m.measured, 20e0 + (1e0 - abs(lat) / 90e0) * 15e0
                             + sin((month(date) - 3) * pi() / 6e0) * 10e0 AS temp,
                             greatest(0e0, 0.4e0 - (1e0 - abs(lat) / 90e0) * 0.3e0) AS rain
                      FROM ({rows}) r
                      LEFT JOIN measured_weather m
                      ON m.hotel_id = r.hotel_id AND m.month = month(r.date))))"""


_VIEWS = {
    "hotels": f"""
    SELECT s_suppkey AS hotel_id, s_name AS name, n_name AS city,
           -60e0 + ((s_suppkey * 37) % 1201) / 10e0 AS lat,
           -180e0 + ((s_suppkey * 91) % 3600) / 10e0 AS lon,
           CAST(3 + s_suppkey % 3 AS INTEGER) AS star_rating,
           {_BASE.format(key="s_suppkey")} AS base_price,
           CAST(45 + (s_suppkey * 13) % 348 AS INTEGER) AS total_rooms,
           CASE s_suppkey % 3 WHEN 0 THEN '["Pool","Spa","Gym"]'
                WHEN 1 THEN '["Restaurant","Bar"]' ELSE '[]' END AS amenities
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "price_history": f"""
    SELECT *, {_BASE.format(key="hotel_id")} * {_weather_multiplier("weather_score")}
                 * (0.75e0 + demand_score * 0.6e0) * {_scarcity("supply_factor")} AS price
    FROM (SELECT *, 1e0 - occupancy_rate / 100e0 AS supply_factor
          FROM (SELECT l_suppkey AS hotel_id, CAST(l_shipdate AS DATE) AS recorded_date,
                       15e0 + (l_quantity - 1e0) * 70e0 / 49e0 AS occupancy_rate,
                       0.3e0 + 7e0 * l_discount AS weather_score,
                       0.2e0 + 8.75e0 * l_tax AS demand_score, l_orderkey, l_linenumber,
                       (l_orderkey * 37) % 91 AS days_ahead
                FROM lineitem))""",
    "bookings": f"""
    SELECT *, check_in + CAST(1 + booking_id % 7 AS INTEGER) AS check_out
    FROM (SELECT o_orderkey AS booking_id, o_orderkey % {_SUPPLIERS} AS hotel_id,
                 o_custkey AS guest_id, CAST(o_orderdate AS DATE) AS created_date,
                 (o_orderkey * 37) % 91 AS lead_days,
                 CAST(o_orderdate AS DATE) + CAST((o_orderkey * 37) % 91 AS INTEGER) AS check_in,
                 1 + o_orderkey % 3 AS rooms, o_totalprice AS price_paid,
                 CASE WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE 'confirmed' END AS status
          FROM orders)""",
    "reviews": f"""
    SELECT event_id AS review_id, event_id % {_SUPPLIERS} AS hotel_id,
           'user_' || user_id AS reviewer_name,
           3.5e0 + ((event_id * 7) % 16) / 10e0 AS rating, event_type AS comment,
           ts AS created_at
    FROM events""",
    "events_calendar": """
    SELECT n_name AS city, CAST(o_orderdate AS DATE) AS date,
           max(CASE WHEN o_totalprice >= 450000 THEN 0.5e0 ELSE 0.3e0 END) AS uplift
    FROM orders JOIN nation ON n_nationkey = o_custkey % 25
    WHERE o_totalprice >= 400000 GROUP BY ALL""",
    "query_points": """
    SELECT c_custkey AS point_id, -90e0 + ((c_custkey * 53) % 1801) / 10e0 AS point_lat,
           -180e0 + ((c_custkey * 71) % 3601) / 10e0 AS point_lon
    FROM customer""",
    "nights": """
    SELECT hotel_id, night, CAST(sum(rooms) AS BIGINT) AS booked_rooms
    FROM (SELECT hotel_id, rooms,
                 CAST(unnest(generate_series(check_in, check_out - 1, INTERVAL 1 DAY)) AS DATE)
                     AS night
          FROM bookings WHERE status <> 'cancelled')
    GROUP BY ALL""",
    "supply": """
    SELECT hotel_id, night, booked_rooms,
           greatest(0e0, least(1e0, 1e0 - CAST(booked_rooms AS DOUBLE) / total_rooms))
               AS supply_factor
    FROM nights JOIN hotels USING (hotel_id)""",
    "measured_weather": """
    SELECT hotel_id, month(recorded_date) AS month, round(avg(weather_score), 9) AS measured
    FROM price_history GROUP BY ALL""",
    "measured_demand": """
    SELECT hotel_id, isodow(recorded_date) - 1 AS weekday, round(avg(demand_score), 9) AS measured
    FROM price_history GROUP BY ALL""",
    "hotel_year": f"""
    SELECT hotel_id, city, lat, {_AS_OF} + CAST(k AS INTEGER) AS date
    FROM hotels, (SELECT unnest(range(365)) AS k)""",
    "weather_year": _weather_view("SELECT * FROM hotel_year"),
    "found": f"""
    SELECT * FROM (SELECT *, {_distance(*_POINT, "lat", "lon")} AS distance_km FROM hotels)
    WHERE distance_km <= {_RADIUS} ORDER BY star_rating DESC, hotel_id LIMIT 20""",
    "found_weather": _weather_view(f"SELECT *, {_AS_OF} + 1 AS date FROM found"),
    "offers": f"""
    SELECT *, {_price("base_price", "weather_score", "demand_score", "supply_factor", "1")}
               AS raw_price
    FROM (SELECT w.*, coalesce(s.supply_factor, 1e0) AS supply_factor,
                 {_demand("w.date", "e.uplift")} AS demand_score
          FROM found_weather w
          LEFT JOIN supply s ON s.hotel_id = w.hotel_id AND s.night = w.date
          LEFT JOIN events_calendar e ON e.city = w.city AND e.date = w.date
          {_measured_demand("w")})""",
    "forecast_days": f"""
    SELECT hotel_id, name, city, lat, base_price, k AS day_offset,
           {_AS_OF} + CAST(k AS INTEGER) AS date
    FROM hotels, (SELECT unnest(range(30)) AS k)""",
    "forecast_weather": _weather_view("SELECT * FROM forecast_days"),
    "forecast": f"""
    SELECT *, {_price("base_price", "weather_score", "demand_score", "supply_factor",
                      "day_offset")} AS raw_price
    FROM (SELECT w.*, coalesce(s.supply_factor, 1e0) AS supply_factor,
                 {_demand("w.date", "e.uplift")} AS demand_score
          FROM forecast_weather w
          LEFT JOIN supply s ON s.hotel_id = w.hotel_id AND s.night = w.date
          LEFT JOIN events_calendar e ON e.city = w.city AND e.date = w.date
          {_measured_demand("w")})""",
    "detail_weather": _weather_view(f"SELECT *, {_AS_OF} AS date FROM hotels"),
    "ranked_reviews": """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hotel_id
                       ORDER BY created_at DESC, review_id DESC) AS review_rank FROM reviews)
    WHERE review_rank <= 5""",
    "market": f"""
    SELECT h.*, (1e0 - coalesce(s.supply_factor, 1e0)) * 100e0 AS occupancy,
           base_price * total_rooms * (1e0 - coalesce(s.supply_factor, 1e0)) AS revenue,
           {_tier("base_price")} AS tier
    FROM hotels h LEFT JOIN supply s ON s.hotel_id = h.hotel_id AND s.night = {_AS_OF}""",
    "hotel_days": """
    SELECT hotel_id, recorded_date, avg(weather_score) AS weather_score,
           avg(demand_score) AS demand_score
    FROM price_history GROUP BY ALL""",
    "rolling": """
    SELECT hotel_id, recorded_date, demand_score,
           avg(weather_score) OVER (PARTITION BY hotel_id ORDER BY recorded_date
               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_weather
    FROM hotel_days""",
    "hotel_months": """
    SELECT hotel_id, city, month_start, avg_price
    FROM (SELECT hotel_id, CAST(date_trunc('month', recorded_date) AS DATE) AS month_start,
                 avg(price) AS avg_price
          FROM price_history GROUP BY ALL) JOIN hotels USING (hotel_id)""",
    "ratios": f"""
    SELECT hotel_id, city, price / base_price AS ratio, {_IN_TRAINING} AS training
    FROM price_history JOIN hotels USING (hotel_id)""",
    "plain": """
    SELECT r.*, coalesce(own, (SELECT avg(ratio) FROM ratios WHERE training)) AS prediction
    FROM ratios r LEFT JOIN (SELECT hotel_id, avg(ratio) AS own FROM ratios WHERE training
                             GROUP BY hotel_id) t ON t.hotel_id = r.hotel_id
    WHERE NOT training""",
    "signals": f"""
    SELECT event_id AS signal_id, event_id % {_SUPPLIERS} AS hotel_id, ts AS event_time,
           0.3e0 + ((event_id * 13) % 101) * 0.7e0 / 100e0 AS weather_score,
           0.2e0 + ((event_id * 17) % 101) * 0.7e0 / 100e0 AS demand_score,
           0.15e0 + ((event_id * 29) % 101) * 0.7e0 / 100e0 AS supply_factor,
           event_id % 91 AS days_ahead
    FROM events""",
}


def _with_views(body: str) -> str:
    """Puts the views that a query uses, and those they use, ahead of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({_VIEWS[name]})" for name in needed) + "\n" + body


# --- queries ------------------------------------------------------------------

_LINE = "l_orderkey, l_linenumber, hotel_id"
_SEARCH = f"""hotel_id, name, star_rating, {_rounded("distance_km", 6)},
           {_significant("raw_price")},
           {_rounded("(raw_price - base_price) / base_price * 100e0", 6, "change_pct")},
           true AS shown_as_rounded, demand_score, supply_factor,
           CAST(trunc(total_rooms * supply_factor) AS INTEGER) AS available_rooms,
           weather_score, condition, 'High' AS time_urgency"""
_STATS = f"""
    SELECT hotel_id, {_significant("avg(price)", "avg_price")},
           {_significant("stddev_samp(price)", "price_volatility")},
           {_rounded("avg(occupancy_rate)", 6, "avg_occupancy")},
           max(price) AS peak_price, min(price) AS floor_price,
           {_rounded(_corr("weather_score", "price"), 8, "weather_price_correlation")},
           {_rounded(_corr("demand_score", "price"), 8, "demand_price_correlation")}
    FROM price_history WHERE hotel_id IN (SELECT hotel_id FROM hotels{{where}})
    GROUP BY hotel_id"""
_MEASURES = """'avg_price', 'price_volatility', 'avg_occupancy', 'peak_price', 'floor_price',
    'weather_price_correlation', 'demand_price_correlation'"""
_MARKET = f"""
    count(*) AS total_hotels, {_rounded("avg(occupancy)", 8, "avg_occupancy")},
    {_rounded("sum(revenue)", 2, "total_revenue_estimate")},
    count(*) FILTER (tier = 'budget') AS budget, count(*) FILTER (tier = 'mid') AS mid,
    count(*) FILTER (tier = 'luxury') AS luxury
    FROM market"""


def _finding(kind: str, group: str, base: str, price: str, factor: str, table: str) -> str:
    chosen, other = f"avg({price}) FILTER ({group})", f"avg({price}) FILTER ({base})"
    error = (
        f"stddev_samp({price}) FILTER ({group}) "
        f"/ (sqrt(count({price}) FILTER ({group})) * {chosen})"
    )
    return f"""
    SELECT '{kind}' AS recommendation, count({price}) FILTER ({group}) AS records,
           {_rounded(chosen, 4, "group_price")}, {_rounded(other, 4, "base_price")},
           {_rounded(f"({chosen} / {other} - 1e0) * 100e0", 7, "uplift_pct")},
           {_rounded(_corr(factor, price), 8, "correlation")},
           {_rounded(f"greatest(0e0, least(1e0, 1e0 - {error}))", 8, "confidence")}
    FROM {table}"""


def _missing(table: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, 'missing' AS check_name, '{column}' AS column_name, "
        f"count(*) FILTER ({column} IS NULL) AS violations FROM {table}"
    )


def _repeated(table: str, *key: str) -> str:
    columns = ", ".join(key)
    return (
        f"SELECT '{table}', 'repeated', '{','.join(key)}', CAST(coalesce(sum(n - 1), 0) AS BIGINT) "
        f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {columns})"
    )


def _orphan(table: str, column: str, parent: str, key: str) -> str:
    return (
        f"SELECT '{table}', 'orphan', '{column}', count(*) FROM {table} child "
        f"WHERE child.{column} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {parent} p WHERE p.{key} = child.{column})"
    )


_AUDIT = "\nUNION ALL ".join(
    [
        *[
            _missing("hotels", name)
            for name in (
                "name",
                "city",
                "lat",
                "lon",
                "star_rating",
                "base_price",
                "total_rooms",
            )
        ],
        *[_missing("reviews", name) for name in ("hotel_id", "rating")],
        *[_missing("bookings", name) for name in ("hotel_id", "check_in", "status")],
        _missing("price_history", "hotel_id"),
        _repeated("reviews", "review_id"),
        _orphan("bookings", "hotel_id", "hotels", "hotel_id"),
        _repeated("hotels", "hotel_id"),
        _repeated("bookings", "booking_id"),
        _repeated("price_history", "l_orderkey", "l_linenumber"),
        _repeated("price_history", "hotel_id", "recorded_date"),
        _orphan("reviews", "hotel_id", "hotels", "hotel_id"),
        _orphan("price_history", "hotel_id", "hotels", "hotel_id"),
        _orphan("price_history", "l_orderkey", "bookings", "booking_id"),
        _orphan("bookings", "guest_id", "customer", "c_custkey"),
        _orphan("events", "user_id", "hotels", "hotel_id"),
        _orphan("documents", "doc_id", "labels", "doc_id"),
    ]
)

_WEEKDAY = "isodow(recorded_date) - 1"
_BAND = (
    "CASE WHEN lead_days <= 2 THEN 'last_minute' WHEN lead_days <= 7 THEN 'week' "
    "WHEN lead_days >= 60 THEN 'early_bird' ELSE 'standard' END"
)
_OTHERS = (
    "(sum(avg_price) OVER w - avg_price) / nullif(count(*) OVER w - 1, 0)"
)

_BODIES = {
    "scan_hotels": "SELECT * FROM hotels",
    "scan_hotels_city": f"SELECT * FROM hotels WHERE city = {_CITY}",
    "hotel_lookup": "SELECT * FROM hotels WHERE hotel_id = 7",
    "scan_price_history": f"""
    SELECT hotel_id, {_day("recorded_date")}, occupancy_rate, weather_score, demand_score,
           l_orderkey, l_linenumber, price FROM price_history""",
    "scan_reviews": f"""
    SELECT review_id, hotel_id, reviewer_name, rating, comment, {_moment("created_at")}
    FROM reviews""",
    "load_with_defaults": """
    SELECT hotel_id, name, city, CASE WHEN hotel_id % 5 <> 1 THEN '1 ' || name END AS address,
           lat, lon, star_rating, base_price, total_rooms,
           CASE WHEN hotel_id % 3 <> 2 THEN amenities ELSE '[]' END AS amenities,
           CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS image_url,
           CASE WHEN hotel_id % 2 = 0 THEN 3.5e0 ELSE 4e0 END AS rating,
           CAST(0 AS INTEGER) AS review_count, true AS entered_now
    FROM hotels""",
    "write_history_by_month": f"""
    SELECT {_day("date_trunc('month', recorded_date)", "month_start")}, count(*) AS records,
           {_rounded("sum(occupancy_rate)", 4, "occupancy_total")}, max(price) AS peak_price
    FROM price_history GROUP BY 1""",
    "json_text": "SELECT hotel_id, name, lat, amenities FROM hotels",
    "json_documents": "SELECT * FROM hotels",
    "price_multipliers": f"""
    SELECT {_LINE}, {_weather_multiplier("weather_score")} AS weather_multiplier,
           {_rounded(_demand_multiplier("demand_score"), 8, "demand_multiplier")},
           {_scarcity("supply_factor")} AS scarcity_multiplier,
           {_urgency("days_ahead")} AS urgency_multiplier,
           {_urgency_label("days_ahead")} AS urgency
    FROM price_history""",
    "dynamic_price": f"""
    SELECT {_LINE}, {_rounded(_price("base_price", "weather_score", "demand_score",
                                     "supply_factor", "days_ahead"), 4, "price")}
    FROM price_history JOIN hotels USING (hotel_id)""",
    "sql_dynamic_price": f"""
    SELECT {_LINE}, {_rounded(_price("base_price", "weather_score", "demand_score",
                                     "supply_factor", "days_ahead"), 4, "price")},
           true AS whole_price_agrees, {_tier("base_price")} AS tier
    FROM price_history JOIN hotels USING (hotel_id)""",
    "history_price": f"SELECT {_LINE}, price FROM price_history",
    "price_change": f"""
    SELECT {_LINE},
           (price - base_price) / base_price * 100e0 AS price_change_pct,
           CAST(trunc(total_rooms * supply_factor) AS INTEGER) AS available_rooms,
           {_urgency_label("days_ahead")} AS time_urgency
    FROM price_history JOIN hotels USING (hotel_id)""",
    "market_columns": "SELECT hotel_id, occupancy, revenue, tier FROM market",
    "hotel_amenities": """
    SELECT hotel_id, amenity
    FROM hotels LEFT JOIN (
        SELECT hotel_id AS id, unnest(from_json(amenities, '["VARCHAR"]')) AS amenity
        FROM hotels) ON id = hotel_id""",
    "calendar_columns": f"""
    SELECT booking_id, {_day("check_in")}, {_day("check_in + CAST(rooms AS INTEGER)", "later")},
           CAST(month(check_in) AS BIGINT) AS month,
           CAST(isodow(check_in) - 1 AS BIGINT) AS weekday
    FROM bookings""",
    "feature_columns": f"""
    SELECT {_LINE}, star_rating, price / base_price AS price_ratio,
           demand_score * weather_score AS demand_weather_interaction,
           occupancy_rate / 100e0 AS occupancy_normalized
    FROM price_history JOIN hotels USING (hotel_id)""",
    "hotel_distance": f"""
    SELECT hotel_id, {_rounded(_distance(*_SEARCH_POINT, "lat", "lon"), 6, "distance_km")}
    FROM hotels""",
    "scalar_math": f"""
    SELECT hotel_id, {_rounded("radians(lat)", 9, "radians")},
           {_rounded("sin(radians(lat))", 9, "sine")},
           {_rounded("cos(radians(lat))", 9, "cosine")},
           {_rounded("acos(cos(radians(lat)))", 9, "arc")},
           {_rounded("pow(abs(lat) / 90e0, 1.4e0)", 9, "power")},
           {_rounded("pi() * lat / 180e0", 9, "half_turn")},
           {_rounded("greatest(-30e0, least(30e0, lat))", 9, "clamped")},
           CAST(trunc(lat) AS INTEGER) AS truncated
    FROM hotels""",
    "weather_signal": f"""
    SELECT hotel_id, {_day("date")}, weather_score AS score, condition
    FROM weather_year""",
    "demand_signal": f"""
    SELECT y.hotel_id, {_day("y.date", "date")}, {_demand("y.date", "e.uplift")} AS demand_score
    FROM hotel_year y LEFT JOIN events_calendar e ON e.city = y.city AND e.date = y.date
    {_measured_demand("y")}""",
    "hotel_days_grid": f"SELECT hotel_id, day_offset, {_day('date')} FROM forecast_days",
    "history_with_hotels": f"""
    SELECT {_LINE}, city, star_rating, base_price, price
    FROM price_history JOIN hotels USING (hotel_id)""",
    "latest_reviews": f"""
    SELECT hotel_id, review_rank, review_id, reviewer_name, rating, {_moment("created_at")}
    FROM ranked_reviews""",
    "hotel_reviews": """
    SELECT h.hotel_id, name, count(review_id) OVER (PARTITION BY h.hotel_id) AS shown,
           review_id, rating, comment
    FROM hotels h LEFT JOIN ranked_reviews r ON r.hotel_id = h.hotel_id""",
    "search_radius": f"""
    SELECT hotel_id, name, star_rating, {_rounded("distance_km", 6)} FROM found""",
    "search_laid_out": f"""
    SELECT hotel_id, name, star_rating, {_rounded("distance_km", 6)} FROM found""",
    "search_hotels": f"SELECT {_SEARCH} FROM offers",
    "search_document": f"""
    SELECT {_SEARCH}, least(total, 7) AS total, place - 1 AS position
    FROM (SELECT *, count(*) OVER () AS total,
                 row_number() OVER (ORDER BY star_rating DESC, hotel_id) AS place FROM offers)
    WHERE place <= 7""",
    "search_batch": f"""
    SELECT point_id, result_rank, hotel_id, star_rating, {_rounded("distance_km", 4)}
    FROM (SELECT *, row_number() OVER (PARTITION BY point_id
                        ORDER BY star_rating DESC, hotel_id) AS result_rank
          FROM (SELECT *, {_distance("point_lat", "point_lon", "lat", "lon")} AS distance_km
                FROM query_points CROSS JOIN hotels)
          WHERE distance_km <= {_BATCH_RADIUS})
    WHERE result_rank <= 20""",
    "price_forecast": f"""
    SELECT hotel_id, name, {_day("date")}, {_significant("raw_price")}, weather_score,
           condition, demand_score, supply_factor
    FROM forecast""",
    "forecast_documents": f"""
    SELECT hotel_id, name AS hotel_name, count(*) OVER (PARTITION BY hotel_id) AS days,
           day_offset AS position, {_day("date")}, weather_score, demand_score AS demand, condition
    FROM forecast""",
    "hotel_detail": f"""
    SELECT hotel_id, name, array_to_string(from_json(amenities, '["VARCHAR"]'), ',') AS amenities,
           coalesce(reviews, '') AS reviews, {_rounded("coalesce(ratings, 0e0)", 6, "ratings")},
           {_significant(_price("base_price", "weather_score", "demand_score",
                                "supply_factor", "1"), "raw_price")},
           true AS shown_as_rounded, demand_score AS current_demand, weather_score, condition
    FROM (SELECT w.*, coalesce(s.supply_factor, 1e0) AS supply_factor,
                 {_demand("w.date", "e.uplift")} AS demand_score, reviews, ratings
          FROM detail_weather w
          LEFT JOIN supply s ON s.hotel_id = w.hotel_id AND s.night = w.date
          LEFT JOIN events_calendar e ON e.city = w.city AND e.date = w.date
          {_measured_demand("w")}
          LEFT JOIN (SELECT hotel_id, sum(rating) AS ratings,
                            string_agg(review_id || '/' || reviewer_name || '/' || comment, ','
                                       ORDER BY review_rank) AS reviews
                     FROM ranked_reviews GROUP BY hotel_id) r ON r.hotel_id = w.hotel_id)""",
    "market_summary": f"SELECT {_MARKET}",
    "market_by_city": f"SELECT city, {_MARKET} GROUP BY city",
    "market_tiers": """
    SELECT tier, (SELECT count(*) FROM market m WHERE m.tier = t.tier) AS hotels
    FROM (VALUES ('budget'), ('mid'), ('luxury')) t(tier)""",
    "top_hotels": f"""
    SELECT hotel_id, name, {_rounded("occupancy", 1)}, {_rounded("revenue", 0)},
           star_rating AS stars
    FROM market ORDER BY round(market.revenue, 0) DESC, hotel_id LIMIT 5""",
    "market_document": f"""
    SELECT (SELECT count(*) FROM market) AS total_hotels,
           (SELECT round(sum(revenue), 0) FROM market) AS total_revenue_estimate,
           (SELECT count(*) FROM market WHERE tier = 'budget') AS budget,
           (SELECT count(*) FROM market WHERE tier = 'mid') AS mid,
           (SELECT count(*) FROM market WHERE tier = 'luxury') AS luxury,
           position - 1 AS position, name, {_rounded("occupancy", 1)},
           {_rounded("revenue", 0)}, star_rating AS stars
    FROM (SELECT *, row_number() OVER (ORDER BY round(revenue, 0) DESC, hotel_id) AS position
          FROM market)
    WHERE position <= 5""",
    "hotel_stats": _STATS.format(where=""),
    "hotel_stats_city": _STATS.format(where=f" WHERE city = {_CITY}"),
    "weekly_pattern": f"""
    SELECT CAST({_WEEKDAY} AS BIGINT) AS weekday,
           {_rounded("avg(demand_score)", 9, "avg_demand")}, count(*) AS records
    FROM price_history GROUP BY 1""",
    "peak_days": f"""
    SELECT weekday, {_rounded("avg_demand", 9)}, rank() OVER (ORDER BY avg_demand DESC)
               AS demand_rank
    FROM (SELECT CAST({_WEEKDAY} AS BIGINT) AS weekday, avg(demand_score) AS avg_demand
          FROM price_history GROUP BY 1)""",
    "monthly_index": f"""
    SELECT CAST(month(recorded_date) AS BIGINT) AS month,
           {_rounded("avg(demand_score)", 9, "avg_demand")},
           {_rounded("avg(demand_score) / (SELECT avg(demand_score) FROM price_history)", 9,
                     "demand_index")},
           count(*) AS records
    FROM price_history GROUP BY 1""",
    "correlations": "\nUNION ALL ".join(
        f"SELECT '{name}' AS factor, {_rounded(_corr(x, y), 8, 'correlation')}, "
        f"count(*) AS pairs FROM {table}"
        for name, x, y, table in (
            ("weather_vs_price", "weather_score", "price", "price_history"),
            ("demand_vs_price", "demand_score", "price", "price_history"),
            ("supply_vs_price", "supply_factor", "price", "price_history"),
            (
                "lead_time_vs_price",
                "lead_days",
                "price_paid",
                "bookings WHERE status <> 'cancelled'",
            ),
        )
    ),
    "rolling_weather": f"""
    SELECT hotel_id, {_day("recorded_date")}, {_rounded("rolling_weather", 9)},
           {_rounded("demand_score", 9)} FROM rolling""",
    "weather_lag": f"""
    SELECT hotel_id, {_rounded(_corr("rolling_weather", "demand_score"), 8,
                               "weather_demand_correlation")}, count(*) AS days
    FROM rolling GROUP BY hotel_id""",
    "competitor_gap": f"""
    SELECT hotel_id, city, {_day("month_start")}, {_significant("avg_price")},
           {_significant("others", "competitor_price")},
           {_rounded("(avg_price - others) / others", 8, "price_gap")}
    FROM (SELECT *, {_OTHERS} AS others FROM hotel_months
          WINDOW w AS (PARTITION BY city, month_start))""",
    "run_summary": """
    SELECT count(*) AS records_processed, count(DISTINCT hotel_id) AS hotels_analyzed
    FROM price_history""",
    "booked_nights": f"""
    SELECT hotel_id, {_day("night")}, booked_rooms FROM nights
    WHERE night BETWEEN {_AS_OF} AND {_UNTIL}""",
    "all_booked_nights": f"SELECT hotel_id, {_day('night')}, booked_rooms FROM nights",
    "supply_factor": f"""
    SELECT hotel_id, {_day("night")}, booked_rooms, supply_factor,
           (1e0 - supply_factor) * 100e0 AS occupancy FROM supply""",
    "segments": f"""
    SELECT segment, count(*) AS bookings,
           {_rounded("count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100e0", 6, "share_pct")},
           {_rounded("avg(lead_days)", 6, "avg_lead_days")},
           {_rounded("avg(price_paid)", 4, "avg_price")},
           {_rounded("covar_pop(ln(price_paid), ln(rooms)) / nullif(var_pop(ln(price_paid)), 0)",
                     8, "price_elasticity")}
    FROM (SELECT *, {_BAND} AS segment FROM bookings WHERE status <> 'cancelled')
    GROUP BY segment""",
    "recommendations": "\nUNION ALL ".join(
        (
            _finding(
                "weekend_surge",
                "isodow(recorded_date) >= 5",
                "isodow(recorded_date) < 5",
                "price",
                "CAST(isodow(recorded_date) >= 5 AS DOUBLE)",
                "price_history",
            ),
            _finding(
                "weather_linked",
                "CAST(trunc((1e0 - weather_score) * 4e0) AS INTEGER) = 0",
                "CAST(trunc((1e0 - weather_score) * 4e0) AS INTEGER) <> 0",
                "price",
                "weather_score",
                "price_history",
            ),
            _finding(
                "early_bird_discount",
                "lead_days >= 60",
                "lead_days > 7 AND lead_days < 60",
                "price_paid",
                "lead_days",
                "bookings WHERE status <> 'cancelled'",
            ),
            _finding(
                "last_minute_premium",
                "lead_days <= 2",
                "lead_days > 7 AND lead_days < 60",
                "price_paid",
                "lead_days",
                "bookings WHERE status <> 'cancelled'",
            ),
        )
    ),
    "overbooking": f"""
    SELECT hotel_id, bookings, {_rounded("c", 9, "cancelled_share")},
           {_rounded("c / nullif(1e0 - c, 0e0)", 9, "overbooking_rate")}
    FROM (SELECT hotel_id, count(*) AS bookings,
                 avg(CASE WHEN status = 'cancelled' THEN 1e0 ELSE 0e0 END) AS c
          FROM bookings GROUP BY hotel_id)""",
    "early_bird_value": f"""
    SELECT early_bird, count(*) AS guests, {_rounded("avg(spend)", 4, "avg_spend")},
           {_rounded("avg(bookings)", 9, "avg_bookings")}
    FROM (SELECT guest_id, sum(price_paid) AS spend, count(*) AS bookings,
                 bool_or(lead_days >= 60) AS early_bird
          FROM bookings WHERE status <> 'cancelled' GROUP BY guest_id) GROUP BY early_bird""",
    "model_split": f"SELECT {_LINE}, {_IN_TRAINING} AS in_training FROM price_history",
    "model_features": f"""
    SELECT {_LINE}, weather_score AS feature_0, demand_score AS feature_1,
           occupancy_rate / 100e0 AS feature_2, demand_score * weather_score AS feature_3,
           CAST(star_rating AS DOUBLE) AS feature_4, price / base_price AS label
    FROM price_history JOIN hotels USING (hotel_id)""",
    "plain_quality": f"""
    SELECT city, {_rounded("sqrt(avg((ratio - prediction) ** 2))", 8, "rmse")},
           {_rounded("1e0 - sum((ratio - prediction) ** 2) / (var_pop(ratio) * count(*))", 8, "r2")},
           count(*) AS records
    FROM plain GROUP BY city""",
    "plain_adjustment": f"""
    SELECT city, hotel_id, {_rounded("(avg(prediction / ratio) - 1e0) * 100e0", 7, "adjustment_pct")},
           count(*) AS records
    FROM plain GROUP BY city, hotel_id""",
    "model_quality": """
    SELECT city, count(*) AS records, true AS beats_plain FROM plain GROUP BY city""",
    "optimise": f"""
    SELECT 'model' AS part, NULL::BIGINT AS hotel_id, 'held_out' AS measure,
           CAST(count(*) AS DOUBLE) AS value FROM plain
    UNION ALL SELECT 'summary', NULL, 'records_processed',
                     CAST(CAST(count(*) AS FLOAT) AS DOUBLE) FROM price_history
    UNION ALL SELECT 'summary', NULL, 'hotels_analyzed', CAST(count(DISTINCT hotel_id) AS DOUBLE)
    FROM price_history
    UNION ALL SELECT 'statistics', hotel_id, unnest([{_MEASURES}]),
                     unnest([avg_price, price_volatility, avg_occupancy,
                             CAST(CAST(peak_price AS FLOAT) AS DOUBLE),
                             CAST(CAST(floor_price AS FLOAT) AS DOUBLE),
                             weather_price_correlation, demand_price_correlation])
    FROM ({_STATS.format(where="")})""",
    "integrity_audit": _AUDIT,
    "stream_reprice": f"""
    SELECT signal_id, hotel_id, city, {_moment("event_time")},
           {_rounded(_price("base_price", "weather_score", "demand_score", "supply_factor",
                            "days_ahead"), 4, "raw_price")}
    FROM signals JOIN hotels USING (hotel_id)""",
    "stream_demand": f"""
    SELECT hotel_id, {_moment("window_start")}, {_moment("window_end")}, count(*) AS events,
           {_rounded("sum(value)", 4, "total_value")}
    FROM (SELECT event_id % {_SUPPLIERS} AS hotel_id, value,
                 time_bucket(INTERVAL 1 DAY, ts) AS window_start,
                 time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end
          FROM events) GROUP BY hotel_id, window_start, window_end""",
}

_BODIES["bucketed_history_with_hotels"] = _BODIES["history_with_hotels"]
_BODIES["bucketed_hotel_stats"] = _BODIES["hotel_stats"]
_BODIES["bucketed_latest_reviews"] = _BODIES["latest_reviews"]

ORACLE = {name: _with_views(body) for name, body in _BODIES.items()}
