"""How far the sources of a language differ in their words.

Tasks fold whole documents into stripes: for each term the number of documents and the
occurrences by source. Stripes leave a task when they hold too many entries, are merged
by term, and the merged ones give the divergences: each term with what it adds to its
source, and sums over terms for pairs of sources.

All arithmetic is on whole numbers. A source gives a term the chance
``p = 1 + floor(SCALE * (count + 1) / (N + V))`` for its ``count`` of the term, its ``N``
occurrences of all ``V`` kept terms of the language, and two chances differ by
``f(p, q) = floor((p - q)^2 / q)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.arrow import map_batches, pieces
from innsight.sources.scratch import scratch_tables, stage_table

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200

ENTRIES = 400_000  # (term, source) counts that a task holds before stripes leave it
PENDING = 1_200_000  # counts of single documents that wait to be added up
ROWS = 10_000  # stripes in a batch
PAIRS = 1 << 19  # pairs of a term's sources worked on at once
SUMS = 1_000_000  # pairs of sources that a task holds before their sums leave it

STRIPES = "lang string, term string, docs long, sources array<string>, counts array<long>"

_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(_TERMS).split()


class Fold:
    """Stripes of one language."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.sources: dict[str, int] = {}
        self.docs = np.zeros(1024, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, source: str, words: list[bytes]) -> int:
        """Takes a document in; returns how many counts it adds to those that wait."""
        terms = self.terms
        for word in set(words).difference(terms):
            terms[word] = len(terms)
        while len(self.docs) < len(terms):
            self.docs = np.concatenate([self.docs, np.zeros_like(self.docs)])
        code = self.sources.setdefault(source, len(self.sources))
        ids = np.fromiter(map(terms.__getitem__, words), np.int64, len(words))
        own, counts = np.unique(ids, return_counts=True)
        self.docs[own] += 1
        self.waiting.append((own << 32 | code, counts))
        self.pending += len(own)
        return len(own)

    def settle(self) -> int:
        """Adds up what waits; returns the number of entries."""
        if len(self.waiting) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.waiting))
            self.waiting = [_added(keys, counts)]
        self.pending = sum(len(k) for k, _ in self.waiting)
        return self.pending

    def batches(self, lang: str) -> Iterator[pa.RecordBatch]:
        if not self.settle():
            return
        keys, counts = self.waiting[0]
        codes = keys & 0xFFFFFFFF
        starts = np.searchsorted(keys >> 32, np.arange(len(self.terms) + 1))
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        names = pa.array(list(self.sources), pa.string())
        for at in range(0, len(terms), ROWS):
            to = min(at + ROWS, len(terms))
            some = slice(starts[at], starts[to])
            offsets = pa.array(starts[at : to + 1] - starts[at], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang], pa.string()).take(pa.array(np.zeros(to - at, np.int32))),
                    terms.slice(at, to - at),
                    pa.array(self.docs[at:to]),
                    pa.ListArray.from_arrays(offsets, names.take(pa.array(codes[some]))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts[some])),
                ],
                ["lang", "term", "docs", "sources", "counts"],
            )


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in ascending order, sum of the values of each)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


def fold_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of a task's documents (lang, source, text)."""
    folds: dict[str, Fold] = {}
    pending = 0
    for batch in batches:
        for part in pieces(batch, "text"):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                if lang not in folds:
                    folds[lang] = Fold()
                pending += folds[lang].add(source, terms_of(text))
                if pending > PENDING:
                    pending = sum(fold.settle() for fold in folds.values())
                    if pending > ENTRIES:
                        for name, fold in folds.items():
                            yield from fold.batches(name)
                        folds, pending = {}, 0
    for name, fold in folds.items():
        yield from fold.batches(name)


def merged(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """One stripe for each term, of stripes in the order of language and term; terms of
    fewer than ``min_docs`` documents go."""
    open_row = None  # the last term so far, which the next batch may go on with
    for batch in batches:
        table = pa.Table.from_batches([*([open_row] if open_row else []), batch])
        whole = table.combine_chunks().to_batches()
        if whole:
            rows = _merged_batch(whole[0])
            open_row = rows.slice(len(rows) - 1)
            rows = rows.slice(0, len(rows) - 1)
            yield rows.filter(pc.greater_equal(rows.column("docs"), min_docs))
    if open_row:
        yield open_row.filter(pc.greater_equal(open_row.column("docs"), min_docs))


def _changes(*columns: pa.Array) -> np.ndarray:
    """Rows at which one of the columns differs from the row before, and the first."""
    n = len(columns[0])
    found = np.zeros(n, bool)
    found[:1] = True
    for column in columns:
        found[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, n - 1)))
    return np.flatnonzero(found)


def _merged_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    first = _changes(batch.column("lang"), batch.column("term"))
    sources, counts = batch.column("sources"), batch.column("counts")
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(batch))))
    group = np.repeat(group, np.asarray(pc.list_value_length(sources)))
    coded = pc.dictionary_encode(sources.flatten())
    codes = np.asarray(coded.indices).astype(np.int64)
    keys, sums = _added(group << 32 | codes, np.asarray(counts.flatten()))
    starts = pa.array(np.searchsorted(keys >> 32, np.arange(len(first) + 1)), pa.int32())
    names = coded.dictionary.take(pa.array(keys & 0xFFFFFFFF))
    at = pa.array(first)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("lang").take(at),
            batch.column("term").take(at),
            pa.array(np.add.reduceat(np.asarray(batch.column("docs")), first)),
            pa.ListArray.from_arrays(starts, names),
            pa.ListArray.from_arrays(starts, pa.array(sums)),
        ],
        batch.schema.names,
    )


def _differs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms that two sources share add to the pair, beyond what each adds
    against a source without it. Rows (lang, term, source, p, p0) come in the order of
    language and term."""
    names: dict[tuple[str, str], int] = {}
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([*([rest] if rest else []), batch]).combine_chunks()
        if not len(table):
            continue
        whole = table.to_batches()[0]
        first = _changes(whole.column("lang"), whole.column("term"))
        rest = whole.slice(first[-1])
        held = _add_pairs(whole.slice(0, first[-1]), first[:-1], names, held)
        if len(held[0]) > SUMS:
            yield _pair_batch(held, names)
            held = (held[0][:0], held[1][:0])
    if rest:
        held = _add_pairs(rest, np.zeros(1, np.int64), names, held)
    if len(held[0]):
        yield _pair_batch(held, names)


def _add_pairs(batch: pa.RecordBatch, first: np.ndarray, names: dict, held: tuple) -> tuple:
    n = len(batch)
    if not n:
        return held
    both = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
    for name in set(both).difference(names):
        names[name] = len(names)
    codes = np.fromiter(map(names.__getitem__, both), np.int64, n)
    p, p0 = (np.asarray(batch.column(c)) for c in ("p", "p0"))
    sizes = np.diff(np.append(first, n))
    start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    ends = np.cumsum(size)
    found, at = [held], 0
    while at < n:
        done = ends[at] - size[at]
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        left = np.repeat(np.arange(at, to), size[at:to])
        right = start[left] + np.arange(len(left)) - (ends[left] - size[left] - done)
        apart = left != right
        left, right = left[apart], right[apart]
        value = _differs(p[left], p[right]) - _differs(p[left], p0[right])
        value += _differs(p0[left], p0[right]) - _differs(p0[left], p[right])
        found.append(_added(codes[left] << 32 | codes[right], value))
        at = to
    return _added(*(np.concatenate(x) for x in zip(*found)))


def _pair_batch(held: tuple[np.ndarray, np.ndarray], names: dict) -> pa.RecordBatch:
    keys, sums = held
    langs, sources = (pa.array(x, pa.string()) for x in zip(*names))
    left, right = pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)
    columns = [langs.take(left), sources.take(left), sources.take(right), pa.array(sums)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def chance(count: str, occurrences: str, terms: str) -> Column:
    """p of a count, exact for any whole numbers."""
    top = f"cast({SCALE} as decimal(10,0)) * (cast({count} as decimal(19,0)) + 1)"
    return F.expr(f"1 + ({top}) div (cast({occurrences} as decimal(19,0)) + {terms})")


def differs(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def stripes_of(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(lang, term, docs, sources, counts): for each language the terms of at least
    ``min_docs`` of its documents, with the occurrences in each source that has them.

    Nulls count as ''. Every row is a document, repeated ones too. A term is one row
    a task before the shuffle (or a few, where stripes had to leave), however often
    it occurs, so a frequent term or a large source gathers nowhere.
    """
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in
            ((lang, "lang"), (source, "source"), (text, "text"))]
    parts = map_batches(docs.select(*read), fold_documents, STRIPES)
    ordered = parts.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(lambda batches: merged(batches, min_docs), STRIPES)


def audit_sources(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every pair of language and source.

    Part ``pair``: every other source of the language and how far it is, summed over the
    kept terms. Part ``term``: the ``top_terms`` terms that the source gives a higher
    chance than its language and adds most by. Ranks start at 1; equal values rank by
    item. Nulls count as '', and a source of two languages is two groups. An empty
    table gives no rows; a group without kept terms has only pairs, of value 0 where
    the language has no kept term.
    """
    spark = docs.sparkSession
    with scratch_tables(spark, "stripes") as stage:
        stripes = stage(stripes_of(docs, lang, source, text, min_docs))
        groups = docs.select(
            F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        ).distinct()
        entries = stripes.select(
            "lang",
            "term",
            F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"),
            F.explode(F.arrays_zip("sources", "counts")).alias("entry"),
        ).select("lang", "term", "total", "entry.sources", "entry.counts")
        entries = entries.withColumnsRenamed({"sources": "source", "counts": "count"})
        langs = stripes.groupBy("lang").agg(
            F.count(F.lit(1)).alias("v"),
            F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n_lang"),
        )
        sums = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        totals = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        totals = totals.fillna(0, ["n", "v", "n_lang"])
        totals = stage(totals.withColumn("p0", F.when(F.col("v") > 0, chance("0", "n", "v"))))

        rated = entries.join(totals, ["lang", "source"]).withColumn("p", chance("count", "n", "v"))
        by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        terms = (
            rated.withColumn("q", chance("total", "n_lang", "v"))
            .where("p > q")
            .select("lang", "source", F.col("term").alias("item"), F.expr(differs("p", "q")).alias("value"))
            .withColumn("rank", F.row_number().over(by_value))
            .where(F.col("rank") <= top_terms)
        )
        pairs = (
            _pair_values(rated, totals)
            .groupBy("lang", "source", "item")
            .agg(F.sum("value").alias("value"))
            .withColumn("rank", F.row_number().over(by_value))
        )
        both = pairs.withColumn("part", F.lit("pair")).unionByName(
            terms.withColumn("part", F.lit("term"))
        )
        return stage_table(both.select("lang", "source", "part", "item", "value", "rank"), "audit")


def _pair_values(rated: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) whose sums are the divergences of pairs.

    The sum over all terms is that over terms that both lack, V times; what a source's
    own terms change in it, which hangs on their counts only, so terms of one count are
    taken together; and what terms of both change in that.
    """
    other = totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    # the result itself has a row for each of these pairs
    facing = totals.join(other, "lang").where("source <> item")
    none = facing.select(
        "lang", "source", "item", F.expr(f"coalesce(v * {differs('p0', 'q0')}, 0)").alias("value")
    )
    alike = rated.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    facing = alike.join(other, "lang").where("source <> item")
    own = facing.select(
        "lang", "source", "item", F.expr(f"m * ({differs('p', 'q0')} - {differs('p0', 'q0')})").alias("value")
    )
    others = facing.select(
        "lang",
        F.col("item").alias("source"),
        F.col("source").alias("item"),
        F.expr(f"m * ({differs('q0', 'p')} - {differs('q0', 'p0')})").alias("value"),
    )
    ordered = rated.select("lang", "term", "source", "p", "p0")
    ordered = ordered.repartition("lang", "term").sortWithinPartitions("lang", "term")
    shared = ordered.mapInArrow(pair_sums, "lang string, source string, item string, value long")
    return none.unionByName(own).unionByName(others).unionByName(shared)
