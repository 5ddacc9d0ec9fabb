"""Connected components of a stored set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.sources.scratch import remove_folder, staged


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): for every node of a link the smallest node it reaches.

    Alternates large-star and small-star steps, which hang all neighbours of a node
    on the smallest one. A step is an aggregate with map-side combine and a join, so
    a node with very many links is no single task. Each round is written to the
    shared folder, where it takes the last one's place; three numbers a round reach the
    driver. Null ends and links of a
    node with itself count for nothing.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    pairs = pairs.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    spark = links.sparkSession
    pairs, folder = staged(pairs.distinct(), "links")
    before = None
    while True:
        last = folder
        pairs, folder = staged(_small_star(_large_star(pairs)), "links")
        remove_folder(spark, last)
        # each round is a set of (node, smaller node) links; equal sets mean a fixed point
        state = tuple(
            pairs.agg(
                F.count(F.lit(1)),
                F.expr("bit_xor(xxhash64(u, v))"),
                F.sum(F.xxhash64("v", "u") % 1_000_003),
            ).first()
        )
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()
