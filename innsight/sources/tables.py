"""Loading tables and writing tables and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions.geo import curve_key
from innsight.sources.schemas import TABLES


def apply_defaults(df: DataFrame, name: str) -> DataFrame:
    """Fills nulls of the columns that have a default, if the frame has them."""
    filled = {
        column: F.coalesce(F.col(column), F.expr(value).cast(df.schema[column].dataType))
        for column, value in TABLES[name].defaults.items()
        if column in df.columns
    }
    return df.withColumns(filled) if filled else df


def load_table(
    spark: SparkSession, name: str, path: str | None = None, format: str = "parquet", **options
) -> DataFrame:
    """One of the known tables from any source Spark reads (parquet, orc, json,
    csv, jdbc, ...), with its declared schema and its defaults.

    No schema is inferred and nothing passes through the driver; filters and
    column choices made on the result reach the scan. JDBC brings its own schema
    and takes ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``
    among the options, to be read in parallel.
    """
    reader = spark.read.format(format).options(**options)
    if format != "jdbc":
        reader = reader.schema(TABLES[name].schema)
    return apply_defaults(reader.load(path) if path else reader.load(), name)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """A stored table as the queries take it: the key under its own name and, for
    bookings, the guest, the booking date and the days from it to check-in."""
    table = TABLES[name]
    df = df.withColumnRenamed(table.key, table.key_alias)
    if name == "bookings":
        created = F.to_date("created_at")
        df = df.withColumns(
            {
                "guest_id": F.col("guest_name"),
                "created_date": created,
                "lead_days": F.date_diff("check_in", created),
            }
        )
    return df


def with_month(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("month_start", F.trunc(F.col(date), "month"))


def write_table(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    sort_by: str | None = None,
    format: str = "parquet",
    near: tuple[str, str] | None = None,
    files: int | None = None,
) -> None:
    """Replaces the table at ``path``.

    With ``partition_by`` the rows are first rebalanced on that column: each
    directory gets few, evenly sized files, and a value that holds a large part
    of the rows is split over several tasks instead of landing in one. Sorting
    inside the files makes their column statistics selective for ``sort_by``.

    ``near`` names columns of latitude and longitude (not with the two above): rows are
    dealt to ``files`` (as many as Spark sees fit) and sorted along a curve through
    the plane, so a file or row group covers a small area, and a search in a box
    skips all whose statistics lie outside. The curve is cut by a sample of the keys,
    so dense areas take more files and none is heavier than others.
    """
    if near:
        key = curve_key(*near)
        df = df.repartitionByRange(*([files] if files else []), key).sortWithinPartitions(key)
    if partition_by:
        df = df.hint("rebalance", partition_by)
    if sort_by:
        order = [partition_by, sort_by] if partition_by else [sort_by]
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode("overwrite").format(format)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def to_json_documents(df: DataFrame, column: str = "document") -> DataFrame:
    """Every row as one JSON text; null fields are kept."""
    return df.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column)
    )


def from_json_documents(documents: DataFrame, schema, column: str = "document") -> DataFrame:
    """The rows back from JSON texts."""
    parsed = documents.select(F.from_json(F.col(column), schema).alias("row"))
    return parsed.select("row.*")


def write_json(df: DataFrame, path: str) -> None:
    """Replaces the folder at ``path`` with one JSON document per line."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
