"""Market overview: totals, price tiers and the strongest hotels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import constants as C
from innsight.functions import pricing as P
from innsight.functions.signals import date_ahead
from innsight.operators.nights import with_supply

TIERS = ("budget", "mid", "luxury")


def market_columns(hotels: DataFrame, as_of=None, supply: DataFrame | None = None) -> DataFrame:
    """Occupancy, estimated revenue and price tier of every hotel on a night."""
    night = date_ahead(as_of, F.lit(0))
    if supply is not None:
        supply = supply.where(F.col("night") == night)
    rows = with_supply(hotels.withColumn("date", night), supply)
    return rows.withColumns(
        {
            "occupancy": P.occupancy_percent("supply_factor"),
            "revenue": P.revenue_estimate("base_price", "total_rooms", "supply_factor"),
            "tier": P.price_tier("base_price"),
        }
    )


def market_summary(market: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hotel count, mean occupancy, revenue and hotels per tier, overall or per
    group. An empty market gives zeros."""
    tiers = [F.count_if(F.col("tier") == name).alias(name) for name in TIERS]
    return market.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_hotels"),
        F.coalesce(F.avg("occupancy"), F.lit(0.0)).alias("avg_occupancy"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue_estimate"),
        *tiers,
    )


def market_tiers(market: DataFrame) -> DataFrame:
    """The tier counts as rows; a tier without hotels has zero."""
    counts = market.agg(*[F.count_if(F.col("tier") == name).alias(name) for name in TIERS])
    return counts.unpivot([], list(TIERS), "tier", "hotels")


def top_hotels(market: DataFrame, k: int = C.MARKET_TOP) -> DataFrame:
    """The ``k`` hotels with the highest rounded revenue; ties go to the lower id."""
    shown = market.select(
        "hotel_id",
        "name",
        F.round("occupancy", 1).alias("occupancy"),
        F.round("revenue", 0).alias("revenue"),
        F.col("star_rating").alias("stars"),
    )
    return shown.orderBy(F.col("revenue").desc(), F.col("hotel_id")).limit(k)


def market_document(market: DataFrame, k: int = C.MARKET_TOP) -> DataFrame:
    """Everything in one row: totals, tier counts and the top hotels as a list."""
    row = F.struct(
        (-F.col("revenue")).alias("order"), "hotel_id", "name", "occupancy", "revenue", "stars"
    )
    shown = ("name", "occupancy", "revenue", "stars")
    best = top_hotels(market, k).agg(
        F.transform(
            F.sort_array(F.collect_list(row)),
            lambda item: F.struct(*[item[name].alias(name) for name in shown]),
        ).alias("top_hotels")
    )
    return market_summary(market).select(
        "total_hotels",
        F.round("avg_occupancy", 1).alias("avg_occupancy"),
        F.round("total_revenue_estimate", 0).alias("total_revenue_estimate"),
        F.struct(*TIERS).alias("price_distribution"),
        best.scalar().alias("top_hotels"),
    )
