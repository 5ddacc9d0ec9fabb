"""SimHash near-duplicates by multi-index hashing.

The fingerprint of a text is the majority of the hashes of its word shingles, bit
by bit. Two fingerprints that differ in few bits differ in even fewer within some
segment of the fingerprint: with three segments and four bits, in one at most.
Each distinct fingerprint enters the table under each of its segments and asks the
table for every value in a small Hamming ball around them; the join compares the
whole fingerprints, so only true links leave it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.arrow import field, free_names, with_text_columns
from innsight.llm.components import connected_components
from innsight.sources.scratch import stage_table

BITS = 64
SHINGLE = 4
MAX_BITS = 4
SEGMENTS = 3
SEED = 42

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number; a text without words has zero."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _AT_ONCE):
        some = zip(starts[at : at + _AT_ONCE], stops[at : at + _AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in some], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(majority.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the column fingerprint; null and empty texts have zero."""

    def make():
        return lambda texts: [[fingerprint(t or "", shingle) for t in texts]]

    return with_text_columns(docs, text, [field("fingerprint", T.LongType())], make)


def _segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))


def near_pairs(
    prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS
) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in ``prints`` (column
    ``fingerprint``) that differ in ``max_bits`` bits at most, once each."""
    radius = max_bits // segments
    parts = _segments(segments)
    value = F.col("fingerprint")

    def keyed(number: int, masks: list[int]) -> Column:
        low, width = parts[number]
        tag = F.lit(number << 56)
        ball = F.array(*[F.lit(m).cast("long") for m in masks])
        own = _segment(value, low, width).bitwiseOR(tag)
        return F.transform(ball, lambda m: own.bitwiseXOR(m))

    def rows(radius: int, name: str) -> DataFrame:
        arrays = []
        for number, (_, width) in enumerate(parts):
            flips = (c for r in range(radius + 1) for c in combinations(range(width), r))
            arrays.append(keyed(number, [sum(1 << bit for bit in c) for c in flips]))
        key = F.explode(F.concat(*arrays)).alias("key")
        return prints.select(value.alias(name), key)

    a, b = F.col("a"), F.col("b")
    near = F.bit_count(a.bitwiseXOR(b)) <= max_bits
    # a pair is met in every segment that is near; it is reported in the first
    first = F.lit(True)
    segment = F.shiftright(F.col("probe.key"), 56)
    for number, (low, width) in enumerate(parts[:-1]):
        far = F.bit_count(_segment(a.bitwiseXOR(b), low, width)) > radius
        first = first & ((segment <= number) | far)
    probe, table = rows(radius, "a").alias("probe"), rows(0, "b").alias("table")
    condition = (F.col("probe.key") == F.col("table.key")) & (a < b) & near & first
    return probe.join(table, condition).select("a", "b")


def _groups(prints: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """(fingerprint, root) of a stored frame's fingerprints that have links."""
    distinct = prints.select("fingerprint").distinct()
    links = stage_table(near_pairs(distinct, max_bits, segments), "near_pairs")
    return connected_components(links, "a", "b").select(
        F.col("node").alias("fingerprint"), "root"
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    segments: int = SEGMENTS,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (long), component_id.

    component_id is the smallest id of the documents that links of at most
    ``max_bits`` bits reach, the document itself included. Equal fingerprints are
    one node, so copies are never paired. Texts without words share the
    fingerprint zero and link like any other. Documents without id are linked but
    lend no id: a component of none but those has a null id. Repeated rows stay.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = stage_table(with_fingerprint(own, "text", shingle).drop("text"), "fingerprints")
    roots = _groups(prints, max_bits, segments)
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    segments: int = SEGMENTS,
) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id
    (null last), among equal ids the one with the smallest row hash. Rows equal in
    id and text are one document and stay as one row."""
    value = F.col(text).cast("string")
    *key, number = free_names(docs, "row_hash", "row_check", "row_number")
    row = dict(zip(key, (F.xxhash64(F.col(doc_id), value), F.hash(value, F.col(doc_id)))))
    own = docs.select(
        F.col(doc_id).alias("doc_id"), value.alias("text"), *[c.alias(n) for n, c in row.items()]
    )
    prints = stage_table(with_fingerprint(own, "text", shingle).drop("text"), "fingerprints")
    roots = _groups(prints, max_bits, segments)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)
    best = prints.groupBy("fingerprint").agg(F.min(order).alias("best"))
    rooted = best.join(roots, "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    kept = rooted.groupBy("root").agg(F.min("best").alias("best"))
    kept = stage_table(kept.select(*[f"best.{n}" for n in key]).distinct(), "kept_documents")
    # one of equal rows, limited to one a task before the shuffle; the join that follows
    # finds the rows where they are
    same = Window.partitionBy(*key).orderBy(*key)
    once = docs.withColumns(row).withColumn(number, F.row_number().over(same))
    once = once.where(F.col(number) <= 1).drop(number)
    return once.join(kept, key, "left_semi").select(*docs.columns)
