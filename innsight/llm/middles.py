"""Fill-in-the-middle rearrangement of texts cut at line boundaries.

The end offsets of all lines of a text form a learned index: segments of a straight
line from rank to offset, none further off than a stated error, and the residual of
every rank. A cut is predicted from its segment and corrected by its residual, which
gives the exact offset without the list of offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from innsight.llm.arrow import field, free_names, map_batches, pieces

#: Fixed marks of the parts of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

SEED = 7
RATE = 100  # of 100 texts, how many are rearranged
SUFFIX_FIRST = 50  # of 100 rearranged texts, how many start with their suffix
ERROR = 32  # code points between a predicted and a true offset
BLOCK = 64  # ranks looked at first when a segment is fitted


def line_ends(text: str) -> np.ndarray:
    """Offsets in code points at which 0, 1, ... lines have ended; a last line needs
    no line feed."""
    if text.isascii():
        points = np.frombuffer(text.encode(), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    parts = [np.zeros(1, np.int64), ends]
    if text and text[-1] != "\n":
        parts.append(np.array([len(text)]))
    return np.concatenate(parts)


class RankIndex:
    """Segments from rank to offset, and what they miss.

    Segment i covers the ranks from ``starts[i]`` and predicts
    ``bases[i] + slopes[i] * (rank - starts[i])``, rounded down.
    """

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        starts, slopes, at = [], [], 0
        while at < len(offsets):
            taken, slope = _segment(offsets, at, error)
            starts.append(at)
            slopes.append(slope)
            at += taken
        self.error = error
        self.starts = np.array(starts, np.int64)
        self.slopes = np.array(slopes)
        self.bases = offsets[self.starts]
        ranks = np.arange(len(offsets))
        missed = offsets - self.predict(ranks)
        # the bound holds up to the rounding of a prediction
        self.residuals = missed.astype(np.min_scalar_type(-error - 2))

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        own = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[own] + np.floor(self.slopes[own] * (ranks - self.starts[own])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of some ranks."""
        return self.predict(ranks) + self.residuals[ranks]


def _segment(offsets: np.ndarray, start: int, error: int) -> tuple[int, float]:
    """(ranks, slope) of the longest segment from ``start`` whose line stays within
    ``error``: the slopes that all its ranks allow are an interval that only shrinks."""
    low, high, done, block = 0.0, np.inf, 1, BLOCK
    base = offsets[start]
    while start + done < len(offsets):
        some = offsets[start + done : start + done + block] - base
        steps = np.arange(done, done + len(some))
        lows = np.maximum(np.maximum.accumulate((some - error) / steps), low)
        highs = np.minimum(np.minimum.accumulate((some + error) / steps), high)
        fits = int(np.searchsorted(lows > highs, True))
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
            done += fits
        if fits < len(some):
            break
        block *= 2
    return done, (low + high) / 2 if done > 1 else 0.0


def rearrange(text: str, draws: tuple[int, ...], rate: int, suffix_first: int, error: int) -> tuple:
    """(lines, form, prefix length, middle length, output, segments) of one text."""
    ends = line_ends(text)
    n = len(ends) - 1
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text, None
    index = RankIndex(ends, error)
    first, last = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = index.offsets(np.array([first, last])).tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < suffix_first:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, a, b - a, output, len(index.starts)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from a document's id; a null id counts as no text."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    error: int = ERROR,
) -> DataFrame:
    """``docs`` with n (lines), form (plain, psm or spm), prefix_chars, middle_chars
    (null if plain), output and n_segments (of the text's index, null if plain).

    Columns of these names are replaced. A null text counts as empty. An empty text,
    and one that holds a mark, stays plain. Rows neither move nor go; repeated rows
    with one id are cut alike. No line longer than a batch is needed in memory
    beyond the text it is in.
    """
    fields = [
        field("n", T.LongType()),
        field("form", T.StringType()),
        field("prefix_chars", T.LongType()),
        field("middle_chars", T.LongType()),
        field("output", T.StringType()),
        field("n_segments", T.IntegerType()),
    ]
    new = {f.name for f in fields}
    kept = [f for f in docs.schema if f.name not in new]
    names = [f.name for f in kept]
    *drawn, read = free_names(docs, "draw1", "draw2", "draw3", "draw4", "read")
    columns = dict(zip(drawn, draws(F.col(doc_id), seed)))
    columns[read] = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kinds = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, read):
                drawn_rows = zip(*(part.column(d).to_pylist() for d in drawn))
                made = [
                    rearrange(t, d, rate, suffix_first, error)
                    for t, d in zip(part.column(read).to_pylist(), drawn_rows)
                ]
                arrays = [part.column(c) for c in names]
                arrays += [pa.array(v, k) for v, k in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [*names, *(f.name for f in fields)])

    ready = docs.withColumns(columns).select(*(F.col(f"`{c}`") for c in names), *drawn, read)
    return map_batches(ready, run, T.StructType([*kept, *fields]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Texts hold no mark and a mark
    cannot overlap itself, so the first one found is the one that was set."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_spm, prefix_spm, middle_spm = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_spm, middle_spm, suffix_spm))
        .otherwise(output)
    )
