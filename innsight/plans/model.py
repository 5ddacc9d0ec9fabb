"""Random-forest model of the price ratio and what follows from it."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions import constants as C
from innsight.functions.features import with_features
from innsight.operators.forest import forest_nodes, forest_prediction
from innsight.plans.history import with_hotel_columns

#: Columns that the training, its split and the reports read; no others are stored.
KEPT = (
    "hotel_id",
    "city",
    "recorded_date",
    "price",
    "occupancy_rate",
    "weather_score",
    "demand_score",
)
CHOSEN = "in_training"  # the column of a stored feature table that marks its training part
ROWS_SQUARED = 200  # the training rows of a partition are so many times the partitions


def feature_table(history: DataFrame, hotels: DataFrame, city: str | None = None) -> DataFrame:
    """History rows with the model's features and label."""
    return with_features(with_hotel_columns(history, hotels, city))


def complete(features: DataFrame) -> DataFrame:
    """The rows a model can use: every feature and the label are present."""
    return features.dropna(subset=[*C.FEATURES, C.LABEL])


def training_columns(features: DataFrame) -> DataFrame:
    """What has to be stored of the feature table, with the training part marked."""
    kept = features.select(*dict.fromkeys([*KEPT, *C.FEATURES, C.LABEL]))
    return kept.withColumn(CHOSEN, in_training())


def in_training() -> Column:
    """Whether a row belongs to the training part: a bucket of the md5 of its hotel,
    date and price in cents. The answer does not depend on partitioning, equal rows
    stay on one side, and any other engine can repeat it."""
    cents = F.floor(F.col("price") * F.lit(100.0)).cast("string")
    date = F.date_format("recorded_date", "yyyy-MM-dd")
    text = F.concat_ws("|", F.col("hotel_id").cast("string"), date, cents)
    bucket = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
    return bucket % F.lit(100) < C.TRAIN_PERCENT


def layout_of(rows: int) -> int:
    """Partitions for a number of training rows: partitions and rows in each both grow with
    its root, so neither becomes too many."""
    return max(1, math.ceil(math.sqrt(rows / ROWS_SQUARED)))


def _laid_out(rows: DataFrame, partitions: int) -> DataFrame:
    """The training rows by a hash of their values, sorted within each partition. The
    forest draws its samples by partition, so the layout is a parameter of the model:
    with it the same rows give the same model on any cluster."""
    return rows.repartition(partitions, *rows.columns).sortWithinPartitions(*rows.columns)


def assembler() -> VectorAssembler:
    """The features as one vector; rows without one of them are left out."""
    return VectorAssembler(
        inputCols=list(C.FEATURES), outputCol="features", handleInvalid="skip"
    )


def train_price_model(
    features: DataFrame,
    partitions: int | None = None,
    chosen: Column | None = None,
    **forest,
) -> PipelineModel:
    """Fits the pipeline on the training part.

    ``features`` is read in several passes, so it should be a stored table (see
    ``scratch_tables``), not a join. ``partitions`` lays the rows out and belongs to
    the model; by default the number of rows decides (see ``layout_of``). ``chosen``
    marks the training part where that is stored already. ``forest`` overrides
    parameters of the regressor, for example ``maxMemoryInMB`` on large clusters.
    """
    parameters = {"numTrees": C.TREES, "maxDepth": C.TREE_DEPTH, "seed": C.SEED} | forest
    regressor = RandomForestRegressor(featuresCol="features", labelCol=C.LABEL, **parameters)
    chosen = in_training() if chosen is None else chosen
    train = complete(features).where(chosen).select(*C.FEATURES, C.LABEL)
    laid_out = _laid_out(train, partitions or layout_of(train.count()))
    return Pipeline(stages=[assembler(), regressor]).fit(laid_out)


def mean_ratio_prediction(features: DataFrame) -> DataFrame:
    """The complete rows with a plain prediction to compare a model with: the mean
    ratio of the hotel's training rows, or of all where it has none. Both come from
    the sums by hotel, one pass over the training rows."""
    rows = complete(features)
    train = rows.where(in_training())
    sums = train.groupBy("hotel_id").agg(F.sum(C.LABEL).alias("total"), F.count(C.LABEL).alias("records"))
    own = sums.select("hotel_id", (F.col("total") / F.col("records")).alias("own_mean"))
    overall = sums.agg(F.try_divide(F.sum("total"), F.sum("records"))).scalar()
    joined = rows.join(own, "hotel_id", "left")
    return joined.withColumn("prediction", F.coalesce("own_mean", overall)).drop("own_mean")


def price_forest(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The nodes of a fitted pipeline's forest, to be stored and to predict with."""
    return forest_nodes(spark, model.stages[-1])


def predict(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """The complete rows with their predicted price ratio, from the nodes of a forest."""
    rows = complete(features)
    return rows.withColumn("prediction", forest_prediction(nodes, list(C.FEATURES)))


def evaluate(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """RMSE and R2 in a single pass, overall or per group."""
    label, error = F.col(C.LABEL), F.col(C.LABEL) - F.col("prediction")
    spread = F.var_pop(label) * F.count(label)
    return predictions.groupBy(*(by or [])).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), spread)).alias("r2"),
        F.count(F.lit(1)).alias("records"),
    )


def price_adjustment(predictions: DataFrame, by: list[str]) -> DataFrame:
    """By how many percent the model would move prices, per group."""
    change = F.avg(F.try_divide(F.col("prediction"), F.col(C.LABEL))) - F.lit(1.0)
    return predictions.groupBy(*by).agg(
        (change * F.lit(100.0)).alias("adjustment_pct"), F.count(F.lit(1)).alias("records")
    )
