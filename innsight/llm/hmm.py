"""Language-model scores by a hidden Markov model over word classes.

A text is its lower-case words and an end. Every word has a class, a hash of its
ending, so a new word has one as well. A chain of hidden states emits the classes,
and a class emits its words as often as the corpus holds them. The likelihood of a
text is the scaled forward recursion over its classes times the share of each word
in its class; it is computed exactly, for texts of any length.

What is learned covers every training text whole: word counts, the parts of a mixture
that the states begin as, and the Baum-Welch counts of states and classes. Each task
computes the counts of its texts and Spark adds them up.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.arrow import map_batches, pieces
from innsight.sources.scratch import stage_table

STATES = 6
CLASSES = 4096  # the end's class is the next number
ENDING = 4  # bytes of a word that decide on its class
PASSES = 2  # Baum-Welch passes over the training texts
#: Words with their counts that every task holds; the others are joined.
FREQUENT = 150_000
MIXTURE_PASSES = 3  # over the training texts, for the first parameters
COUNTED = 200_000  # different words that a task holds before it hands them on
GATHERED = 6_000_000  # tokens that a task sorts by length of text
BLOCK = 1_000_000  # tokens in one recursion
LEARNED_AT_ONCE = 250_000  # tokens of a text whose states are held together
END = CLASSES

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:] if len(word) > ENDING else b"^" + word) % CLASSES


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """Adds a little to every count, so that nothing is impossible."""
        start, move, emit = start + 0.1, move + 0.1, emit + 0.01
        return cls(
            start / start.sum(),
            move / move.sum(1, keepdims=True),
            emit / emit.sum(1, keepdims=True),
        )

    @classmethod
    def first(cls, weights: np.ndarray, emit: np.ndarray) -> Model:
        """From the parts of a mixture of class frequencies, one for each state: states
        rarely change."""
        common = emit.sum(0) / max(1.0, emit.sum())
        return cls.from_counts(weights, 20 * np.eye(STATES) + 0.2, emit + 0.05 * common)


def first_part(classes: np.ndarray) -> int:
    """The part of the mixture that a text begins in: by chance, alike for equal texts."""
    return zlib.crc32(classes.tobytes()) % STATES


def mixture_counts(
    parts: tuple[np.ndarray, np.ndarray] | None, texts: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Texts by part, and their classes by part: each text counts in the parts as likely
    as they make it, or in its first part where there are no ``parts`` yet."""
    flat = np.concatenate(texts)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    if parts is None:
        share = np.eye(STATES)[[first_part(t) for t in texts]]
    else:
        weights, emit = parts
        emit = emit + 0.05
        logs = np.log(emit / emit.sum(1, keepdims=True))
        share = np.stack([np.add.reduceat(own[flat], starts) for own in logs], axis=1)
        share += np.log((weights + 1e-6 * (1 + weights.sum())) / (1 + weights.sum()))
        share = np.exp(share - share.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    emit = np.stack([np.bincount(flat, np.repeat(own, lengths), CLASSES + 1) for own in share.T])
    return share.sum(0), emit


def packed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes by place in the text, then by length of text, the longest first; the
    number of texts that reach each place; which text each class is of."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    flat = np.concatenate([texts[i] for i in order])
    begins = np.cumsum(sorted_lengths) - sorted_lengths
    place = np.arange(len(flat)) - np.repeat(begins, sorted_lengths)
    moved = np.argsort(place, kind="stable")
    reach = np.searchsorted(-sorted_lengths, -np.arange(sorted_lengths[0]), side="left")
    return flat[moved], reach, np.repeat(order, sorted_lengths)[moved]


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each sequence of classes."""
    seen, reach, owner = packed(texts)
    emit, move = np.ascontiguousarray(model.emit.T), model.move
    scales = np.empty(len(seen))
    at, state = 0, None
    for m in reach.tolist():
        here = emit[seen[at : at + m]]
        state = here * model.start if state is None else here * (state[:m] @ move)
        scale = state.sum(1)
        state /= scale[:, None]
        scales[at : at + m] = scale
        at += m
    return np.bincount(owner, np.log(scales), len(texts))


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of first states, transitions, and emissions by state."""
    seen, reach, _ = packed(texts)
    emit, move = np.ascontiguousarray(model.emit.T), model.move
    n = len(seen)
    forward, scales = np.empty((n, STATES)), np.empty(n)
    at, state = 0, None
    for m in reach.tolist():
        here = emit[seen[at : at + m]]
        state = here * model.start if state is None else here * (state[:m] @ move)
        scale = state.sum(1)
        state /= scale[:, None]
        scales[at : at + m], forward[at : at + m] = scale, state
        at += m
    # backward: ``coming`` is emission times backward over scale of the next place
    moves = np.zeros((STATES, STATES))
    back = move.T.copy()
    emissions = np.zeros((STATES, CLASSES + 1))
    coming = np.zeros((0, STATES))
    for m in reach[::-1].tolist():
        at -= m
        own = np.ones((m, STATES))
        k = len(coming)
        if k:
            own[:k] = coming @ back
            moves += forward[at : at + k].T @ coming
        here = seen[at : at + m]
        coming = emit[here] * own / scales[at : at + m, None]
        forward[at : at + m] *= own
    for k in range(STATES):
        emissions[k] = np.bincount(seen, forward[:, k], CLASSES + 1)
    return forward[: reach[0]].sum(0), moves * move, emissions


def expected_counts_of_long(
    model: Model, text: np.ndarray, at_once: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one long text, with the states of ``at_once`` of its places in memory.

    The forward recursion runs once to learn the state at the end of each stretch, and
    again, from the last stretch to the first, within each while the backward
    recursion goes through it. Nothing is lost where two stretches meet.
    """
    emit, move = np.ascontiguousarray(model.emit.T), model.move
    cuts = range(0, len(text), at_once)

    def forward(cut: int, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        some = emit[text[cut : cut + at_once]]
        states, scales = np.empty((len(some), STATES)), np.empty(len(some))
        for i, here in enumerate(some):
            state = here * model.start if state is None else here * (state @ move)
            scales[i] = state.sum()
            state = states[i] = state / scales[i]
        return states, scales

    entries: list[np.ndarray | None] = [None]
    for cut in cuts[:-1]:
        entries.append(forward(cut, entries[-1])[0][-1])
    moves, emissions = np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES + 1))
    back, coming, first = move.T.copy(), None, np.zeros(STATES)
    for cut, entry in zip(reversed(cuts), reversed(entries)):
        states, scales = forward(cut, entry)
        seen = text[cut : cut + at_once]
        arriving = np.empty_like(states)  # emission times backward over scale, by place
        after = np.empty_like(states)
        for i in range(len(seen) - 1, -1, -1):
            after[i] = 1.0 if coming is None else coming @ back
            coming = arriving[i] = emit[seen[i]] * after[i] / scales[i]
        moves += states[:-1].T @ arriving[1:]
        if entry is not None:
            moves += np.outer(entry, arriving[0])
        own = states * after
        for k in range(STATES):
            emissions[k] += np.bincount(seen, own[:, k], CLASSES + 1)
        first = own[0]
    return first, moves * move, emissions


def blocks(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Indexes of texts of like length, with about BLOCK classes together."""
    chosen, held = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if chosen and held + len(texts[i]) > BLOCK:
            yield chosen
            chosen, held = [], 0
        chosen.append(i)
        held += len(texts[i])
    if chosen:
        yield chosen


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows and their sequences, as many as a task works on at once."""
    held, tokens = [], 0
    for batch in batches:
        for part in pieces(batch, "classes", GATHERED):
            size = int(np.sum(part.column("n_tokens").to_numpy()))
            if held and tokens + size > GATHERED:
                yield _sequences(held)
                held, tokens = [], 0
            held.append(part)
            tokens += size
    if held:
        yield _sequences(held)


def _sequences(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[np.ndarray]]:
    rows = pa.Table.from_batches(held)
    return rows, [np.frombuffer(x, np.uint16) for x in rows["classes"].to_pylist()]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, n) over the column text of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(counts: Counter) -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_pydict(
                {
                    "word": pa.array([w.decode() for w in words], pa.string()),
                    "class": pa.array(list(map(class_of, words)), pa.int32()),
                    "n": pa.array(list(counts.values()), pa.int64()),
                }
            )

        counts: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column("text").to_pylist():
                    counts.update(words_of(text))
                if len(counts) >= COUNTED:
                    yield made(counts)
                    counts = Counter()
        if counts:
            yield made(counts)

    partial = map_batches(docs.select("text"), run, "word string, class int, n long")
    return partial.groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """Words of the highest counts, at most ``most``, down to a power of 2 ** 0.25."""
    step = F.floor(F.log2("n") * 4).cast("int").alias("step")
    found = 0
    least = None
    for step_at, n in sorted(map(tuple, counts.groupBy(step).count().collect()), reverse=True):
        if found + n > most:
            break
        found, least = found + n, step_at
    if least is None:
        return []
    return [tuple(r) for r in counts.where(step >= least).select("word", "n").collect()]


def _prepare(docs: DataFrame, frequent: list[tuple[str, int]]) -> DataFrame:
    """A stored row for each text: row, doc_id, held_out, n_tokens (with the end),
    classes, part (sum of log10(count + 0.5) over frequent words), known (how many
    those are) and rare (the other words)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {w.encode(): i for i, (w, _) in enumerate(shared.value)}
        logs = np.log10(np.array([n for _, n in shared.value] + [0.5]) + 0.5)
        logs[-1] = 0  # the place of rare words, which are summed elsewhere
        kinds = np.array([class_of(w) for w in places] + [0], np.uint16)
        for batch in batches:
            for part in pieces(batch, "text"):
                columns: dict[str, list] = {
                    k: [] for k in ("n_tokens", "classes", "part", "known", "rare")
                }
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    at = np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words))
                    classes = np.full(len(words) + 1, END, np.uint16)
                    classes[:-1] = kinds[at]
                    places_rare = np.flatnonzero(at < 0)
                    rare = [words[i] for i in places_rare.tolist()]
                    classes[places_rare] = list(map(class_of, rare))
                    columns["n_tokens"].append(len(words) + 1)
                    columns["classes"].append(classes.tobytes())
                    columns["part"].append(float(logs[at].sum()))
                    columns["known"].append(len(words) - len(rare))
                    columns["rare"].append([w.decode() for w in rare])
                types = (pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.list_(pa.string()))
                arrays = [pa.array(v, t) for v, t in zip(columns.values(), types)]
                names = ["doc_id", "held_out"]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], *arrays], [*names, *columns]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    prepared = map_batches(
        docs.select("doc_id", "held_out", "text"),
        run,
        f"doc_id {kind}, held_out boolean, n_tokens long, classes binary, part double, "
        "known long, rare array<string>",
    )
    # once written, the row numbers are the same for every reader
    return stage_table(prepared.withColumn("row", F.monotonically_increasing_id()), "hmm_texts")


def _summed(stored: DataFrame, size: int, count) -> np.ndarray:
    """The sum over all stored texts of what ``count`` makes of lists of them, ``size``
    numbers each time. Tasks add up their own; Spark adds up by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, texts in _gathered(batches):
            for counts in count(texts):
                total += np.concatenate([c.ravel() for c in counts])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int32()), "n": total[at]})

    counted = map_batches(stored.select("n_tokens", "classes"), run, "place int, n double")
    total = np.zeros(size)
    for place, n in counted.groupBy("place").agg(F.sum("n")).collect():  # of fixed number
        total[place] = n
    return total


def mixture(stored: DataFrame, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of a mixture of class frequencies, after so many passes over all stored
    texts that refine the first parts."""
    parts = None
    for _ in range(passes + 1):
        shared = stored.sparkSession.sparkContext.broadcast(parts)

        def count(texts, shared=shared):
            for chosen in blocks(texts):
                yield mixture_counts(shared.value, [texts[i] for i in chosen])

        total = _summed(stored, STATES * (CLASSES + 2), count)
        parts = total[:STATES], total[STATES:].reshape(STATES, -1)
    return parts


def baum_welch(model: Model, stored: DataFrame) -> Model:
    """One pass over all stored texts, each of them whole."""
    shared = stored.sparkSession.sparkContext.broadcast(model)
    at_once = LEARNED_AT_ONCE

    def count(texts):
        long = [t for t in texts if len(t) > at_once]
        short = [t for t in texts if len(t) <= at_once]
        for chosen in blocks(short):
            yield expected_counts(shared.value, [short[i] for i in chosen])
        for text in long:
            yield expected_counts_of_long(shared.value, text, at_once)

    total = _summed(stored, STATES + STATES**2 + STATES * (CLASSES + 1), count)
    start, move, emit = np.split(total, [STATES, STATES + STATES**2])
    return Model.from_counts(start, move.reshape(STATES, -1), emit.reshape(STATES, -1))


def score_texts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    learn: Column | None = None,
    passes: int = PASSES,
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (by smoothed word frequencies) and score (the model's
    log10 probability of the text).

    ``learn`` chooses the training rows; without it those are learned from whose id
    hashes to another remainder than 1 by 5, rows without id among them. Null and
    empty texts are one end. Repeated rows stay and count each. Without any
    training row all words are unknown and classes equally likely. Counts reach
    the driver only for frequent words, classes and states, whose numbers are
    fixed; the counts of all other words are joined.
    """
    key = F.col(doc_id)
    own = docs.select(
        key.alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        (held_out(key) if learn is None else ~F.coalesce(learn, F.lit(False))).alias("held_out"),
    )
    counts = stage_table(word_counts(own.where("not held_out")), "word_counts")
    stored = _prepare(own, frequent_words(counts, frequent))
    training = stored.where("not held_out")
    ends = training.count()
    words, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, known_end = words + ends, int(ends > 0)
    floor = math.log10(tokens + 0.5 * (different + known_end + 1))
    end_log = math.log10(ends + 0.5)

    model = Model.first(*mixture(training, MIXTURE_PASSES))
    for _ in range(passes):
        model = baum_welch(model, training)

    # log10 of what the words of a class sum up to; the end is alone in its class
    size = np.full(CLASSES + 1, 0.5)
    by_class = counts.groupBy("class").agg(F.sum("n"), F.count(F.lit(1)))
    for number, n, kinds in by_class.collect():  # of fixed number
        size[number] = n + 0.5 * (kinds + 1)
    size[END] = 1
    shared = docs.sparkSession.sparkContext.broadcast((model, np.log10(size)))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sizes = shared.value
        for rows, texts in _gathered(batches):
            chain = np.empty(len(texts))
            for chosen in blocks(texts):
                some = [texts[i] for i in chosen]
                chain[chosen] = log_likelihoods(model, some) / math.log(10)
                chain[chosen] -= [sizes[t].sum() for t in some]
            out = rows.drop_columns(["classes"]).append_column("chain", pa.array(chain))
            yield from out.to_batches()

    chains = map_batches(
        stored.select("row", "doc_id", "held_out", "n_tokens", "part", "known", "classes"),
        run,
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, part double, "
        "known long, chain double",
    )
    rare = stored.select("row", F.explode("rare").alias("word"))
    n = F.coalesce("n", F.lit(0))
    rare = (
        rare.join(counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(n + 0.5)).alias("rare_part"), F.sum((n > 0).cast("long")).alias("rare_known"))
    )
    part = F.col("part") + F.coalesce("rare_part", F.lit(0.0))
    return chains.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + known_end).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (part + end_log - F.col("n_tokens") * floor).alias("base_score"),
        (part + F.col("chain")).alias("score"),
    )
