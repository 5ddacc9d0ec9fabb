"""Benchmark decontamination with one Aho-Corasick automaton over item windows.

Texts are lower-cased (A-Z) and cut into words, which are runs of letters, digits
and characters beyond ASCII. The patterns are all windows of 13 words of an item,
or the whole item if it has fewer. The automaton's alphabet is the benchmark's
words, so a document is scanned once, a step for each word, and every match is a
range of words whose places in the original text are known.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.arrow import field, free_names, map_batches, pieces, with_text_columns
from innsight.sources.scratch import remove_folder, scratch_folder, stage_table

WINDOW = 13
#: Benchmark bytes in one automaton; a larger benchmark is scanned for in several.
SHARD_BYTES = 4 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Automaton:
    """Windows of items: the alphabet, the automaton and the items of a window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.alphabet: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(
                self.alphabet.setdefault(w, len(self.alphabet) + 1) for w in words_of(text)
            )
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[start : start + window], set()).add(item)
        self.items = [frozenset(x) for x in found.values()]
        self.lengths = [len(x) for x in found]
        self.scan = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for number, ids in enumerate(found):
            self.scan.add_word(ids, number)
        if found:
            self.scan.make_automaton()
        self.empty = not found

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit words (end exclusive) and the items found."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return ranges, items
        ids = tuple(map(self.alphabet.get, words, repeat(0)))
        seen = set()
        for end, number in self.scan.iter(ids):
            seen.add(number)
            ranges.append((end + 1 - self.lengths[number], end + 1))
        for number in seen:
            items |= self.items[number]
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def places(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets of word ranges in the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (their ids, sorted as strings), hit_spans
    (code point offsets in the original text, end exclusive) and contaminated;
    columns of these names are replaced.

    A document is contaminated if some word is hit and hit words are at least a
    twentieth. Null and empty texts have no words. Items without id, text or words
    match nothing; items of equal id count once. Every row of ``docs`` stays.

    An automaton is built over ``shard_bytes`` of the benchmark at most, which the
    driver and each task hold. A larger benchmark is written in parts of that size.
    The documents are then searched for one part after the other; what was found of
    a part is stored and its automaton gone before the next.
    """
    known = benchmark.select(
        F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")
    ).where("item is not null and text is not null")
    total = known.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    n = max(1, math.ceil(total / shard_bytes))
    context = docs.sparkSession.sparkContext
    if n == 1:
        shared = context.broadcast([tuple(row) for row in known.collect()])
        found = _settled(docs, text, window, shared)
    else:
        found = _in_parts(docs, text, window, known, n)
    hit, words = F.col("n_hit"), F.col("n_words")
    return found.withColumn("contaminated", (hit > 0) & (hit * 20 >= words))


def _in_parts(docs: DataFrame, text: str, window: int, known: DataFrame, n: int) -> DataFrame:
    """One pass for each part of the benchmark. Texts meet what was found in them by
    digests, so equal texts are searched alike and no row needs a number."""
    spark = docs.sparkSession
    one, two, ranges, items = free_names(docs, "one", "two", "found_ranges", "found_items")

    def digests(value: Column, first: str, second: str) -> dict[str, Column]:
        return {first: F.xxhash64(value, F.lit(1)), second: F.xxhash64(F.lit(2), value)}

    numbered = known.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))
    path = scratch_folder(spark, "benchmark")
    # one folder a part; a hot item's rows are one part whatever they are
    numbered.write.partitionBy("part").parquet(path)
    parts = spark.read.schema(numbered.schema).parquet(path)
    value = F.col(text).cast("string")
    own = docs.select(value.alias("text")).withColumns(digests(F.col("text"), "one", "two"))
    hits = []
    for part in range(n):
        mine = parts.where(F.col("part") == part).select("item", "text").collect()
        shared = spark.sparkContext.broadcast([tuple(row) for row in mine])
        found = map_batches(own.where("text is not null"), _hits(window, shared), HITS)
        hits.append(stage_table(found.dropDuplicates(["one", "two"]), "hits"))
        shared.destroy()
    remove_folder(spark, path)
    met = reduce(DataFrame.unionByName, hits).groupBy(F.col("one").alias(one), F.col("two").alias(two))
    met = met.agg(  # of one text, a part's list each
        F.flatten(F.collect_list("ranges")).alias(ranges),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias(items),
    )
    keyed = docs.withColumns(digests(value, one, two))
    joined = keyed.join(met, [one, two], "left").drop(one, two)
    return _settled(joined, text, window, None, (ranges, items)).drop(ranges, items)


HITS = "one long, two long, ranges array<array<long>>, items array<string>"


def _hits(window: int, shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value, window)
        for batch in batches:
            for part in pieces(batch, "text"):
                found = []
                for row in part.to_pylist():
                    ranges, items = automaton.matches(words_of(row["text"]))
                    if ranges:
                        found.append((row["one"], row["two"], ranges, sorted(items)))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))
                columns = zip(*found) if found else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["one", "two", "ranges", "items"]
                )

    return run


def _settled(
    docs: DataFrame,
    text: str,
    window: int,
    shared: Broadcast | None,
    met: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with the result's columns: searched here, or from the columns with the
    ranges and items that were met before."""
    span = T.ArrayType(T.LongType(), False)
    made = [
        field("n_words", T.LongType()),
        field("items", T.ArrayType(T.StringType(), False)),
        field("n_hit", T.LongType()),
        field("hit_spans", T.ArrayType(span, False)),
    ]

    def make():
        automaton = Automaton(shared.value, window) if shared else None

        def work(texts, ranges=None, items=None):
            columns: list[list] = [[] for _ in made]
            for i, value in enumerate(texts):
                words = words_of(value or "")
                if automaton:
                    own, names = automaton.matches(words)
                else:
                    own, names = merged([tuple(r) for r in ranges[i] or []]), items[i] or []
                row = len(words), sorted(names), sum(b - a for a, b in own), places(value or "", own)
                for column, x in zip(columns, row):
                    column.append(x)
            return columns

        return work

    return with_text_columns(docs, text, made, make, also=met or ())
