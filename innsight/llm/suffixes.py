"""Removal of long repeated substrings, a bucket of suffixes at a time.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else. To
know that of a suffix one needs to know whether any other agrees with it that far,
not the order of all suffixes. So the suffixes are bucketed by a cover sample:

* Cover. In every string of ``length`` bytes the least hashed part of fixed width is
  the sample place. Equal strings have it at the same distance from their start,
  wherever they are: what a difference cover gives for two suffixes, given by the
  content, with a place in about every 70 bytes.
* Ranks. A sample's rank is the hash of its part; ranks that occur once in the corpus
  cannot be in a repeat, and their suffixes are dropped before anything is sorted.
* Buckets. The suffixes around one sample place form a block. Blocks of equal rank and
  equal text, from the first suffix's begin to the last one's end, settle all their
  suffixes at once: the long ties.
* What is left, blocks whose rank others share but whose text nobody does, is sorted
  suffix by suffix, against one block of each text that shares the rank.

Hashes of 96 bits or more stand for strings. Nothing but hashes and places is
shuffled, besides the texts themselves, which meet their places twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.arrow import map_batches, pieces
from innsight.sources.scratch import stage_table

LENGTH = 400
STRETCH = 1 << 17  # starts looked at together; bounds memory on very long texts
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64(0xFFFFF)  # low bits that hold a place within a stretch
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def part_width(length: int) -> int:
    return max(1, length * 16 // 25)


@lru_cache(maxsize=4)
def _tables(size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte, and powers of a base and of its inverse."""
    base = _BASE ^ (seed << 8)
    letters = np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * 2 + 1
    up = np.full(size, base, np.uint64)
    down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return letters, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of all substrings of a stretch of bytes."""

    def __init__(self, data: bytes | memoryview, size: int, seed: int = 1):
        letters, self.up, self.down = _tables(size, seed)
        codes = letters[np.frombuffer(data, np.uint8)]
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], dtype=np.uint64, out=self.sums[1:])

    def of_width(self, width: int) -> np.ndarray:
        """Of every substring of one width."""
        n = len(self.sums) - width
        return _mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])

    def between(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[begins]) * self.down[begins])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, by running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    forward = np.minimum.accumulate(table, 1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def blocks_of(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, number of starts, rank, text hash) of the blocks of a text."""
    width = part_width(length)
    size = STRETCH + 2 * length
    for at in range(0, len(data) - length + 1, STRETCH):
        stretch = memoryview(data)[at : at + STRETCH + length - 1]
        hashes = Hashes(stretch, size)
        ranks = hashes.of_width(width)
        # equal parts differ in place only, so the leftmost of them is the least
        keyed = (ranks & ~_PLACE) | np.arange(len(ranks), dtype=np.uint64)
        least = sliding_least(keyed, length - width + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        end = np.append(first[1:], len(least))
        place = (least[first] & _PLACE).astype(np.int64)
        shape = ((place - first) << 20 | (end - first)).astype(np.uint64)
        text = hashes.between(first, end - 1 + length)
        yield first + at, end - first, ranks[place], _mixed(text ^ shape * np.uint64(_BASE))


def folded(
    first: np.ndarray, starts: np.ndarray, rank: np.ndarray, text: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Blocks of a text with those that repeat within it folded: the first of each
    stays, with the number of all as its times; the others, which are settled, become
    runs with times 0."""
    _, at, times = np.unique(rank ^ text * np.uint64(_BASE), return_index=True, return_counts=True)
    count = np.zeros(len(first), np.int64)
    count[at] = times
    more = np.flatnonzero(count == 0)
    if not len(more):
        return first, starts, rank, text, count
    begin = np.flatnonzero(
        np.concatenate([[True], (np.diff(more) > 1) | (first[more[1:]] != (first + starts)[more[:-1]])])
    )
    runs = more[begin]
    lengths = np.add.reduceat(starts[more], begin)
    at = np.sort(at)
    return (
        np.concatenate([first[at], first[runs]]),
        np.concatenate([starts[at], lengths]),
        np.concatenate([rank[at], rank[runs] + first[runs].astype(np.uint64)]),  # spread
        np.concatenate([text[at], text[runs]]),
        np.concatenate([count[at], np.zeros(len(runs), np.int64)]),
    )


def starts_hashed(data: bytes, first: int, count: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of ``count`` strings from ``first`` on."""
    piece = memoryview(data)[first : first + count - 1 + length]
    size = STRETCH + 2 * length
    one = Hashes(piece, size).of_width(length)
    return one.view(np.int64), Hashes(piece, size, 2).of_width(length).astype(np.uint32).view(np.int32)


def _rows(schema: dict[str, pa.DataType], columns: dict[str, list]) -> pa.RecordBatch:
    arrays = [
        pa.array(np.concatenate(columns[k]) if columns[k] else np.zeros(0), t)
        for k, t in schema.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, list(schema))


def _blocks(length: int):
    schema = {
        "row": pa.int64(),
        "tag": pa.int32(),
        "first": pa.int64(),
        "starts": pa.int32(),
        "rank": pa.int64(),
        "text_hash": pa.int64(),
        "times": pa.int64(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                columns: dict[str, list] = {k: [] for k in schema}
                rows, tags = part.column("row").to_pylist(), part.column("tag").to_pylist()
                for row, tag, text in zip(rows, tags, part.column("text").to_pylist()):
                    for found in blocks_of((text or "").encode(), length):
                        first, starts, rank, hashed, times = folded(*found)
                        columns["row"].append(np.full(len(first), row, np.int64))
                        columns["tag"].append(np.full(len(first), tag, np.int32))
                        columns["first"].append(first)
                        columns["starts"].append(starts.astype(np.int32))
                        columns["rank"].append(rank.view(np.int64))
                        columns["text_hash"].append(hashed.view(np.int64))
                        columns["times"].append(times)
                yield _rows(schema, columns)

    return run


def _suffixes(length: int):
    schema = {
        "row": pa.int64(),
        "tag": pa.int32(),
        "start": pa.int64(),
        "hash": pa.int64(),
        "check": pa.int32(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                columns: dict[str, list] = {k: [] for k in schema}
                for x in part.to_pylist():
                    data = x["text"].encode()
                    for block in x["blocks"]:
                        first, starts = block["first"], block["starts"]
                        hashed, check = starts_hashed(data, first, starts, length)
                        columns["row"].append(np.full(starts, x["row"], np.int64))
                        columns["tag"].append(np.full(starts, x["tag"], np.int32))
                        # those of a settled text are only there to be met
                        here = np.arange(first, first + starts) if block["open"] else np.full(starts, -1)
                        columns["start"].append(here)
                        columns["hash"].append(hashed)
                        columns["check"].append(check)
                yield _rows(schema, columns)

    return run


def runs_of(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings from (first start, number of starts) cover."""
    runs: list[tuple[int, int]] = []
    for first, starts in sorted(ranges):
        end = first + starts - 1 + length
        if runs and first <= runs[-1][1]:
            if end > runs[-1][1]:
                runs[-1] = (runs[-1][0], end)
        else:
            runs.append((first, end))
    return runs


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept")}
                firsts, starts = part.column("firsts").to_pylist(), part.column("starts").to_pylist()
                for text, f, s in zip(part.column("text").to_pylist(), firsts, starts):
                    data = (text or "").encode()
                    runs = runs_of(list(zip(f or [], s or [])), length)
                    at, kept = 0, []
                    for begin, end in runs:
                        kept.append(data[at:begin])
                        at = end
                    kept.append(data[at:])
                    out["n_bytes"].append(len(data))
                    out["n_removed"].append(sum(b - a for a, b in runs))
                    out["spans"].append([list(x) for x in runs])
                    out["kept"].append(b"".join(kept))
                types = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
                arrays = [pa.array(v, t) for v, t in zip(out.values(), types)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *arrays], ["doc_id", *out]
                )

    return run


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """The shuffle files of a stage that is written go at its end, not later."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, spans (maximal
    removed runs of bytes, end exclusive) and kept (the other bytes, binary).

    Repeats are counted over all rows, within one text too, and judged on the texts
    as they came. Null and empty texts have no bytes. Equal rows are repeats of each
    other. A text shorter than ``length`` loses nothing. What is kept may cut a
    character in two, hence bytes.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")
    ).withColumns({"row": F.xxhash64("doc_id", "text"), "tag": F.hash("text", "doc_id")})
    long = own.select("row", "tag", "text").where(F.octet_length("text") >= length)
    with _shuffles_freed(spark):
        every = map_batches(
            long,
            _blocks(length),
            "row long, tag int, first long, starts int, rank long, text_hash long, times long",
        )
        # written, so that both sides of the joins with them are plain exchanges, whose
        # large partitions adaptive execution splits
        shared = every.groupBy("rank").agg(F.sum("times").alias("n")).where("n > 1")
        shared = stage_table(shared.select("rank", F.lit(True).alias("hit")), "ranks")
        found = every.join(shared, "rank", "left").where("hit or times = 0").drop("hit")
        blocks = stage_table(found, "blocks")

        open_blocks = blocks.where("times > 0")
        texts = open_blocks.groupBy("rank", "text_hash").agg(
            F.sum("times").alias("times"), F.min(F.struct("row", "tag", "first", "starts")).alias("one")
        )
        texts = stage_table(texts, "block_texts")
        alone = texts.where("times = 1")
        ranks = stage_table(alone.select("rank").distinct(), "open_ranks")
        met = texts.where("times > 1").join(ranks, "rank", "left_semi")
        wanted = alone.select("one.*", F.lit(True).alias("open")).unionByName(
            met.select("one.*", F.lit(False).alias("open"))
        )
        of_text = wanted.groupBy("row", "tag").agg(  # of one text
            F.collect_list(F.struct("first", "starts", "open")).alias("blocks")
        )
        suffixes = stage_table(
            map_batches(
                long.join(of_text, ["row", "tag"]),
                _suffixes(length),
                "row long, tag int, start long, hash long, check int",
            ),
            "suffixes",
        )
        repeated = suffixes.groupBy("hash", "check").count().where("count > 1")
        repeated = stage_table(repeated.select("hash", "check"), "repeated_suffixes")
        single = suffixes.where("start >= 0").join(repeated, ["hash", "check"], "left_semi")
        several = texts.where("times > 1").select("rank", "text_hash")
        settled = open_blocks.join(several, ["rank", "text_hash"], "left_semi")
        settled = settled.unionByName(blocks.where("times = 0"))
        ranges = settled.select("row", "tag", "first", "starts").unionByName(
            single.select("row", "tag", F.col("start").alias("first"), F.lit(1).alias("starts"))
        )
        ranges = stage_table(
            ranges.groupBy("row", "tag").agg(  # of one text
                F.collect_list(F.struct("first", "starts")).alias("ranges")
            ),
            "ranges",
        )
    kind = own.schema["doc_id"].dataType.simpleString()
    found = own.join(ranges, ["row", "tag"], "left").select(
        "doc_id", "text", F.col("ranges.first").alias("firsts"), F.col("ranges.starts").alias("starts")
    )
    return map_batches(
        found,
        _removed(length),
        f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary",
    )
