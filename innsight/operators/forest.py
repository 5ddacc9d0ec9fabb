"""A regression forest as a table of nodes, and its prediction as an expression."""

from __future__ import annotations

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from innsight.sources.scratch import remove_folder, scratch_folder


def forest_nodes(spark: SparkSession, model: RandomForestRegressionModel) -> DataFrame:
    """(tree, node, left, right, feature, threshold, prediction): the nodes of a fitted
    forest, numbered within each tree from its root 0.

    A leaf has no children (-1); any other node sends a row to the left where its
    feature is at most the threshold. All features are numbers. The rows, no more
    than the model on the driver has nodes, become part of the frame's plan.
    """
    folder = scratch_folder(spark, "forest")
    model.write().save(folder)
    try:
        stored = spark.read.parquet(f"{folder}/data")
        nodes = stored.select(
            F.col("treeID").alias("tree"),
            F.col("nodeData.id").alias("node"),
            F.col("nodeData.leftChild").alias("left"),
            F.col("nodeData.rightChild").alias("right"),
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
            F.col("nodeData.prediction").alias("prediction"),
        )
        return spark.createDataFrame(nodes.toArrow(), nodes.schema)
    finally:
        remove_folder(spark, folder)


def forest_prediction(nodes: DataFrame, features: list[str]) -> Column:
    """The mean prediction of the trees for a row with the feature columns; null where a
    feature is missing.

    Every tree becomes nested conditions, so scoring is compiled with the rest of the
    plan, in one thread of comparisons a row and without a call out of it. The nodes
    are read once, to make the expression, which is as large as the model.
    """
    trees: dict[int, dict[int, Row]] = {}
    for row in nodes.collect():
        trees.setdefault(row["tree"], {})[row["node"]] = row
    named = [f"cast(`{name}` as double)" for name in features]

    def text(tree: dict[int, Row], at: int) -> str:
        node = tree[at]
        if node["left"] < 0:
            return f"{node['prediction']!r}D"
        test = f"{named[node['feature']]} <= {node['threshold']!r}D"
        return f"if({test}, {text(tree, node['left'])}, {text(tree, node['right'])})"

    total = " + ".join(text(tree, 0) for _, tree in sorted(trees.items()))
    known = " and ".join(f"`{name}` is not null" for name in features)
    return F.expr(f"if({known}, ({total}) / {len(trees)}, cast(null as double))")
