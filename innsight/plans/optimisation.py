"""The whole optimisation job: statistics, model, quality and recommendations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import constants as C
from innsight.plans.history import price_statistics, run_summary
from innsight.plans.model import (
    CHOSEN,
    complete,
    evaluate,
    feature_table,
    predict,
    price_adjustment,
    price_forest,
    train_price_model,
    training_columns,
)
from innsight.sources.runs import kept_run
from innsight.sources.scratch import file_system, scratch_tables


@dataclass(frozen=True)
class Optimisation:
    """Results of one job. ``nodes`` are those of the trained forest; ``overall`` and
    ``quality`` (by city) are measured, and ``adjustments`` drawn, on the rows held
    out. The last four are None when there are no rows to train on."""

    summary: DataFrame
    stats: DataFrame
    nodes: DataFrame | None = None
    overall: DataFrame | None = None
    quality: DataFrame | None = None
    adjustments: DataFrame | None = None


def optimise(
    history: DataFrame,
    hotels: DataFrame,
    city: str | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    **forest,
) -> Optimisation:
    """Runs the job for one city or for all cities at once; all frames are lazy.

    The columns that training reads are written to the shared folder for its passes
    and deleted when it is done. Statistics and scoring are single passes and read
    the tables themselves. ``keep``, which stores a frame, is for those who read all
    results: then the feature table stays, every row is scored once, and the results
    read what is stored. An unknown city gives empty results.
    """
    spark = history.sparkSession
    features = training_columns(feature_table(history, hotels, city))
    with scratch_tables(spark, "features") as stage:
        stored = (keep or stage)(features)
        features = stored if keep else features
        stats = price_statistics(features)  # rows of known hotels only
        summary = run_summary(features)
        chosen = F.col(CHOSEN)
        if complete(stored).where(chosen).isEmpty():
            return Optimisation(summary, stats)
        nodes = price_forest(spark, train_price_model(stored, chosen=chosen, **forest))
    held_out = predict(nodes, features.where(~chosen))
    held_out = held_out.select("hotel_id", "city", C.LABEL, "prediction")
    held_out = keep(held_out) if keep else held_out
    return Optimisation(
        summary=summary,
        stats=stats,
        nodes=nodes,
        overall=evaluate(held_out),
        quality=evaluate(held_out, ["city"]),
        adjustments=price_adjustment(held_out, ["hotel_id"]),
    )


def kept_optimisation(
    history: DataFrame,
    hotels: DataFrame,
    tables: list[DataFrame],
    city: str | None = None,
    root: str | None = None,
    **forest,
) -> Optimisation:
    """The job's results as stored tables. They are made where no earlier run has made them
    of the same ``tables``, the stored ones that history and hotels are drawn from; one
    run serves all who ask for any of its results.
    """
    spark = history.sparkSession

    def build(path: str) -> None:
        with scratch_tables(spark, "job") as keep:
            for name, df in vars(optimise(history, hotels, city, keep, **forest)).items():
                if df is not None:
                    df.write.parquet(f"{path}/{name}")

    path = kept_run(spark, "optimisation", tables, build, root, city=city, rules=1, **forest)
    files, _ = file_system(spark, path)
    found = {}
    for name in (f.name for f in fields(Optimisation)):
        folder = f"{path}/{name}"
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder)):
            found[name] = spark.read.parquet(folder)
    return Optimisation(**found)


def job_figures(job: Optimisation) -> DataFrame:
    """(part, hotel_id, measure, value): the summary and all statistics as rows."""
    def rows(df: DataFrame, part: str, key) -> DataFrame:
        measures = [c for c in df.columns if c != "hotel_id"]
        entries = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
        return df.select(F.lit(part).alias("part"), key.alias("hotel_id"), F.inline(F.array(*entries)))

    none = F.lit(None).cast("long")
    return rows(job.summary, "summary", none).unionByName(rows(job.stats, "statistics", F.col("hotel_id").cast("long")))
