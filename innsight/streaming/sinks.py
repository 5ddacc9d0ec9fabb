"""Running a stream over what has arrived and reading its result as a table.

Every micro-batch is a numbered part of a stored table (see ``sources.parts``). The
checkpoint may lose the note that a batch is done and run it again; its part counts
already then, whether by itself or folded into the base, and nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from innsight.sources.parts import PartTable, empty_like
from innsight.sources.scratch import scratch_folder

NUMBER = "batch_id"  # the column that tells versions of a key apart

Transform = Callable[[DataFrame], DataFrame]


def _run(stream: DataFrame, write: Callable, mode: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_to_table(
    stream: DataFrame, path: str, checkpoint: str, transform: Transform = lambda batch: batch
) -> StreamingQuery:
    """Appends the transformed rows of every micro-batch to the table of parts at
    ``path``. A batch that is run again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        PartTable(batch.sparkSession, path).put(batch_id, transform(batch))

    return _run(stream, write, "append", checkpoint)


def update_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the changed rows of every micro-batch, with the batch's number, to the table
    of parts at ``path``. A batch that is run again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        number = F.lit(batch_id).cast("long")
        PartTable(batch.sparkSession, path).put(batch_id, batch.withColumn(NUMBER, number))

    return _run(stream, write, "update", checkpoint)


def _numbered(stream: DataFrame) -> T.StructType:
    # a schema's own add() would change that of the stream
    return T.StructType([*stream.schema.fields, T.StructField(NUMBER, T.LongType())])


def _newest(versions: DataFrame, keys: list[str]) -> DataFrame:
    values = [name for name in versions.columns if name not in keys]
    newest = F.max_by(F.struct(*values), NUMBER).alias("newest")
    return versions.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def read_updated(spark: SparkSession, path: str, stream: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of every key that ``update_table`` has written; no rows if
    there was no input yet."""
    versions = PartTable(spark, path).read(_numbered(stream))
    return _newest(versions, keys).select(*stream.columns)


def compact_updates(spark: SparkSession, path: str, keys: list[str]) -> bool:
    """Folds what ``update_table`` has written into one base with the newest version of
    every key, so that the folder grows with the keys and not with time.

    The stream may run meanwhile. Versions keep their batch's number, and the manifest
    keeps the numbers that were folded, so a batch that comes again meets neither the
    base nor another batch.
    """
    return PartTable(spark, path).fold(lambda versions: _newest(versions, keys))


def run_append(
    stream: DataFrame, name: str, transform: Transform = lambda batch: batch
) -> DataFrame:
    """Processes all available input in append mode and returns the result; no rows if
    there is no input yet."""
    spark = stream.sparkSession
    folder = scratch_folder(spark, name)
    query = append_to_table(stream, f"{folder}/rows", f"{folder}/checkpoint", transform)
    query.awaitTermination()
    table = PartTable(spark, f"{folder}/rows")
    if table.state().folders():
        return table.read()
    return transform(empty_like(stream))


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Processes all available input in update mode and returns the last state."""
    spark = stream.sparkSession
    folder = scratch_folder(spark, name)
    update_table(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return read_updated(spark, f"{folder}/rows", stream, keys)
