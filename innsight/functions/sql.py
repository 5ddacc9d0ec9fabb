"""The price formulas for SQL text, as SQL scalar functions.

They are inlined by the optimizer, so a query that uses them runs the same
built-in expressions as the Column forms.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from innsight.functions import constants as C

_DEFINITIONS = (
    f"""weather_multiplier(weather DOUBLE) RETURNS DOUBLE
        RETURN {C.WEATHER_FLOOR}D + weather * {C.WEATHER_SPAN}D""",
    f"""demand_multiplier(demand DOUBLE) RETURNS DOUBLE
        RETURN {C.DEMAND_FLOOR}D + pow(demand, {C.DEMAND_EXPONENT}D) * {C.DEMAND_SPAN}D""",
    f"""scarcity_multiplier(supply DOUBLE) RETURNS DOUBLE
        RETURN CASE WHEN supply IS NOT NULL THEN
            1D + greatest(0D, ({C.SCARCITY_START}D - supply) * {C.SCARCITY_SLOPE}D) END""",
    f"""urgency_multiplier(days INT) RETURNS DOUBLE
        RETURN CASE WHEN days <= {C.LAST_MINUTE_DAYS} THEN {C.LAST_MINUTE_FACTOR}D
                    WHEN days <= {C.WEEK_DAYS} THEN {C.WEEK_FACTOR}D
                    WHEN days >= {C.EARLY_BIRD_DAYS} THEN {C.EARLY_BIRD_FACTOR}D
                    WHEN days IS NOT NULL THEN 1D END""",
    """dynamic_price(base DOUBLE, weather DOUBLE, demand DOUBLE, supply DOUBLE, days INT)
        RETURNS DOUBLE
        RETURN round(base * weather_multiplier(weather) * demand_multiplier(demand)
            * scarcity_multiplier(supply) * urgency_multiplier(days), 2)""",
    f"""history_price(base DOUBLE, weather DOUBLE, demand DOUBLE, supply DOUBLE)
        RETURNS DOUBLE
        RETURN round(base * weather_multiplier(weather)
            * ({C.DEMAND_FLOOR}D + demand * {C.HISTORY_DEMAND_SPAN}D)
            * scarcity_multiplier(supply), 2)""",
    f"""price_tier(base DOUBLE) RETURNS STRING
        RETURN CASE WHEN base < {C.BUDGET_BELOW}D THEN 'budget'
                    WHEN base < {C.MID_BELOW}D THEN 'mid'
                    WHEN base IS NOT NULL THEN 'luxury' END""",
    f"""distance_km(lat_a DOUBLE, lon_a DOUBLE, lat_b DOUBLE, lon_b DOUBLE) RETURNS DOUBLE
        RETURN CASE WHEN lat_a + lon_a + lat_b + lon_b IS NOT NULL THEN
            {C.EARTH_RADIUS_KM}D * acos(greatest(-1D, least(1D,
                cos(radians(lat_a)) * cos(radians(lat_b)) * cos(radians(lon_b - lon_a))
                + sin(radians(lat_a)) * sin(radians(lat_b))))) END""",
)


def register_sql_functions(spark: SparkSession) -> None:
    """Makes the formulas callable from ``spark.sql`` in this session."""
    for definition in _DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
