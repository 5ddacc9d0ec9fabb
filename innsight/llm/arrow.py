"""Running a function of texts over Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PIECE_BYTES = 2 << 20
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
BATCH_DEFAULT = "67108864b"

Work = Callable[[list], list]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold ``limit`` bytes at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def map_batches(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches for texts.

    Batches are counted in rows first and then in bytes; whole texts make those of
    the default size heavy on both sides of the pipe. The setting is read when a
    frame runs, so it is lowered for the session, unless somebody has set it.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF) == BATCH_DEFAULT:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def with_text_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Work],
    limit: int = PIECE_BYTES,
    end: Callable[[], None] | None = None,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with columns that a function of the text column computes.

    ``make`` runs once in each task and returns the function, which takes a list
    of texts (null: None) and returns a list of values for each field. Fields
    replace columns of the same name; every row stays, in its partition. ``limit`` is
    the bytes of text that are worked on at once; ``end`` runs when a task is done.
    The values of the columns ``also`` names are further arguments of the function.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema if f.name not in new]
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in kept]
    kinds = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch, text, limit):
                made = work(*(part.column(c).to_pylist() for c in (text, *also)))
                columns = [part.column(n) for n in names]
                columns += [pa.array(v, t) for v, t in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(columns, [*names, *(f.name for f in fields)])
        if end:
            end()

    return map_batches(df, run, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)
