"""A stored table of numbered parts, with a manifest that names the live ones.

A part is written to a folder of its own and counts only once a manifest names it.
Manifests have ascending version numbers and are published by a rename that fails
where the version exists, so of two writers one has to look again. A number that is
live, or that has been folded into the base, is never taken a second time: a writer
that runs again after a failure cannot add its rows twice, nor lose what was folded
meanwhile. This needs a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.sources.scratch import file_system, move_new, remove_folder

KEPT_MANIFESTS = 10


@dataclass(frozen=True)
class State:
    """What one manifest says. ``base`` holds the numbers of ``folded``, given as
    ascending ranges; ``parts`` are (first number, last number, folder); ``retired``
    are folders that no longer count and go with the next folding."""

    version: int = 0
    schema: str | None = None
    base: str | None = None
    folded: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    retired: list = field(default_factory=list)

    def folders(self) -> list[str]:
        return [*([self.base] if self.base else []), *(folder for *_, folder in self.parts)]

    def holds(self, first: int, last: int) -> bool:
        """Whether all numbers from first to last count already; some but not all is
        an error."""
        ranges = [*self.folded, *([a, b] for a, b, _ in self.parts)]
        if any(a <= first and last <= b for a, b in joined(ranges)):
            return True
        if any(a <= last and first <= b for a, b in ranges):
            raise ValueError(f"numbers {first} to {last} are there in part")
        return False


def joined(ranges: list) -> list[list[int]]:
    """Ranges in ascending order, those that touch as one."""
    found: list[list[int]] = []
    for a, b in sorted(ranges):
        if found and a <= found[-1][1] + 1:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return found


class PartTable:
    """The table at a folder; the folder need not exist yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- manifests ----------------------------------------------------------------

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _files(self):
        return file_system(self.spark, self.path)[0]

    def _versions(self) -> list[int]:
        files, folder = self._files(), self._path("manifest")
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != ".")

    def state(self) -> State:
        """What the newest manifest says."""
        versions = self._versions()
        if not versions:
            return State()
        stream = self._files().open(self._path("manifest", f"{versions[-1]:012}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return State(**json.loads(text))

    def _publish(self, state: State) -> bool:
        """Makes ``state`` the newest; False if its version is taken."""
        files = self._files()
        draft = self._path("manifest", f".{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(json.dumps(asdict(state)).encode())
        stream.close()
        named = f"{self.path}/manifest/{state.version:012}.json"
        if not move_new(self.spark, draft.toString(), named):
            files.delete(draft, False)
            return False
        for version in self._versions()[:-KEPT_MANIFESTS]:
            files.delete(self._path("manifest", f"{version:012}.json"), False)
        return True

    # --- parts --------------------------------------------------------------------

    def put(self, number: int, df: DataFrame, last: int | None = None) -> bool:
        """Adds ``df`` as the part of a number, or of all numbers up to ``last``. Does
        nothing and says False if they count already, as with a writer that runs again."""
        last = number if last is None else last
        state = self.state()
        if state.holds(number, last):
            return False
        if state.schema and _types(T.StructType.fromJson(json.loads(state.schema))) != _types(df.schema):
            raise ValueError("a part must have the columns of the table")
        folder = f"data/part-{number}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        while True:
            taken = state.holds(number, last)
            new = replace(
                state,
                version=state.version + 1,
                schema=state.schema or df.schema.json(),
                parts=[*state.parts, [number, last, folder]],
            )
            if taken or self._publish(new):
                break
            state = self.state()
        if taken:  # by another writer of the same number
            remove_folder(self.spark, f"{self.path}/{folder}")
        return not taken

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """All rows that count; none, with the given schema, if there is no part."""
        return self._frame(self.state(), schema)

    def _frame(self, state: State, schema: T.StructType | None = None) -> DataFrame:
        if state.schema:
            schema = T.StructType.fromJson(json.loads(state.schema))
        elif schema is None:
            raise ValueError(f"there is no part at {self.path} yet")
        if not state.folders():
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{folder}" for folder in state.folders()]
        return self.spark.read.schema(schema).parquet(*paths)

    def fold(self, merge: Callable[[DataFrame], DataFrame]) -> bool:
        """Replaces the base and all parts by one base with what ``merge`` makes of them.

        Parts that arrive meanwhile stay parts. A reader that has begun goes on with the
        old folders; they go with the folding after this one. False if there was
        nothing to fold, or somebody else has folded in between.
        """
        seen = self.state()
        if not seen.parts:
            return False
        folder = f"data/base-{uuid.uuid4().hex}"
        merge(self._frame(seen)).write.parquet(f"{self.path}/{folder}")
        state = seen
        while state.base == seen.base and all(p in state.parts for p in seen.parts):
            new = replace(
                state,
                version=state.version + 1,
                base=folder,
                folded=joined([*state.folded, *([a, b] for a, b, _ in seen.parts)]),
                parts=[p for p in state.parts if p not in seen.parts],
                retired=seen.folders(),
            )
            if self._publish(new):
                for old in state.retired:
                    remove_folder(self.spark, f"{self.path}/{old}")
                return True
            state = self.state()
        remove_folder(self.spark, f"{self.path}/{folder}")
        return False


def _types(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def empty_like(df: DataFrame) -> DataFrame:
    """No rows of the columns of ``df``, which may be a stream."""
    return df.sparkSession.createDataFrame([], df.schema).select(*(F.col(f"`{c}`") for c in df.columns))
