"""Where intermediate tables and stream checkpoints go."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"

_own_folder: list[str] = []  # of local sessions, one for this process


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names.

    Only a session whose tasks run in this process may use a temporary folder of its
    own where that setting is absent; on a cluster the executors would not see it.
    """
    shared = spark.conf.get(SHARED_DIR, None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError(f"{SHARED_DIR} must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="innsight-"))
    return _own_folder[0]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(file system, path in it) of a path in whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file or folder unless the target exists; False if it does."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(paths[0].toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(*paths, none)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system holds it."""
    files, target = file_system(spark, path)
    files.delete(target, True)


@contextmanager
def scratch_tables(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that stages frames; what it staged is deleted at the end, so
    only what is finished within the block may read it."""
    paths = []

    def stage(df: DataFrame) -> DataFrame:
        path = scratch_folder(spark, name)
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield stage
    finally:
        for path in paths:
            remove_folder(spark, path)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a frame that several jobs read; the written table and its folder.

    This cuts the lineage and, unlike cached blocks, survives lost executors.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """The written table alone, where its readers may come at any time."""
    return staged(df, name)[0]
