"""The first k rows of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.sources.scratch import stage_table

GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
PARTS = 64
LOCAL_ROWS = 1000


def local_rows(df: DataFrame, at_most: int) -> DataFrame:
    """A frame of at most so many rows, computed once for all that reads it: as rows
    within the plan up to LOCAL_ROWS, as a stored table beyond."""
    if at_most > LOCAL_ROWS:
        return stage_table(df, "rows")
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def first_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank: str | None = None,
    spread: list[str] | None = None,
) -> DataFrame:
    """The first ``k`` rows of every key in the given order, which must be total.

    Written as a row number below a limit, which Spark turns into a group limit
    ahead of the shuffle: every task sends at most k rows per key, so a key that
    holds most of the rows costs no more than any other. Spark does so up to a
    threshold of its own; for a larger k the rows of a key are first ranked in
    parts, by a hash of the ``spread`` columns (all without it), and only the first
    k of each part meet.
    """
    number = rank or "row_rank"
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT_CONF)):
        part = F.pmod(F.xxhash64(*(spread or _hashable(df))), F.lit(PARTS))
        split = df.withColumn("rank_part", part)
        df = _ranked(split, [*keys, "rank_part"], order, k, number).drop("rank_part", number)
    ranked = _ranked(df, keys, order, k, number)
    return ranked if rank else ranked.drop(number)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]


def _ranked(df: DataFrame, keys: list[str], order: list[Column], k: int, number: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(window)).where(F.col(number) <= k)


def latest_reviews(reviews: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` reviews of every hotel, newest first by ``review_rank``."""
    order = [F.col("created_at").desc(), F.col("review_id").desc()]
    return first_rows(reviews, ["hotel_id"], order, k, "review_rank", ["review_id"])
