"""Tables stored by the buckets of a key, so that joining and grouping by it moves no row.

A bucket is read by one task. Keys that hold a notable part of the rows would make
one task heavier than all others, so their rows are stored apart, in files of any
order: no key is in both places, what is grouped by the key can be put together
as it is, and the few hot keys meet a broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.operators.lookup import hot_keys, key_hash
from innsight.sources.scratch import file_system


@dataclass(frozen=True)
class Bucketed:
    """A stored table: ``cold`` rows by buckets of ``by``, the ``hot`` keys' rows beside
    them; ``hot_hashes`` are the hashes of those keys."""

    by: str
    cold: DataFrame
    hot: DataFrame
    hot_hashes: list[int]

    def rows(self) -> DataFrame:
        return self.cold.unionByName(self.hot)

    def grouped(self, group: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``group`` makes of the rows, where it groups by ``by`` (and more): nothing is
        shuffled but what the hot keys' rows have been combined to."""
        if not self.hot_hashes:
            return group(self.cold)
        return group(self.cold).unionByName(group(self.hot))

    def lookup(self, dimension: Bucketed, how: str = "inner") -> DataFrame:
        """The rows joined with a table of the same buckets, whose key is unique: cold rows
        stay where they are, hot ones meet the few rows of their keys."""
        if how not in ("inner", "left", "left_semi", "left_anti"):
            raise ValueError(f"unsupported join type: {how}")
        # a key that is there once can be a notable part of a small table
        joined = self.cold.join(dimension.rows() if dimension.hot_hashes else dimension.cold, self.by, how)
        if not self.hot_hashes:
            return joined
        kind = self.cold.schema[self.by].dataType.simpleString()
        few = dimension.rows().where(key_hash([self.by], [kind]).isin(self.hot_hashes))
        return joined.unionByName(self.hot.join(F.broadcast(few), self.by, how))


def write_bucketed(
    df: DataFrame, path: str, by: str, buckets: int, sort_by: list[str] | None = None
) -> None:
    """Stores ``df`` at a new folder. Each bucket is one file, sorted by the key and
    ``sort_by``; ``df`` is read once more before, to find its hot keys."""
    spark = df.sparkSession
    kind = df.schema[by].dataType.simpleString()
    hashes = hot_keys(df, [by])
    is_hot = F.coalesce(key_hash([by], [kind]).isin(hashes), F.lit(False))
    name = _name(f"{path}/writing")
    (
        df.where(~is_hot)
        .repartition(buckets, by)
        .write.bucketBy(buckets, by)
        .sortBy(by, *(sort_by or []))
        .option("path", f"{path}/cold")
        .saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")  # the files stay
    df.where(is_hot).write.parquet(f"{path}/hot")
    note = {"by": by, "buckets": buckets, "sort_by": sort_by or [], "hot": hashes, "schema": df.schema.json()}
    files, target = file_system(spark, f"{path}/layout.json")
    stream = files.create(target)
    stream.write(json.dumps(note).encode())
    stream.close()


def open_bucketed(spark: SparkSession, path: str) -> Bucketed:
    """The table that was stored at a folder. The session's catalog gets an entry for it,
    since only tables of a catalog have buckets; the entry owns no files."""
    files, target = file_system(spark, f"{path}/layout.json")
    stream = files.open(target)
    try:
        note = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    schema = T.StructType.fromJson(json.loads(note["schema"]))
    name = _name(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    order = ", ".join(f"`{c}`" for c in [note["by"], *note["sort_by"]])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{note['by']}`) "
        f"SORTED BY ({order}) INTO {note['buckets']} BUCKETS LOCATION '{path}/cold'"
    )
    hot = spark.read.schema(schema).parquet(f"{path}/hot")
    return Bucketed(note["by"], spark.table(name), hot, note["hot"])


def _name(path: str) -> str:
    return f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
