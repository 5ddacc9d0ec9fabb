"""Quality of texts by a factorisation machine.

Inputs are the words of a text, hashed, with a value each; statistics of its structure
and numbers known about it, each put into one of a few ranges. Every input has a
weight and a short vector; two inputs interact by the product of their vectors. The
sum over all pairs is half of (the square of the sum less the sum of squares) in each
dimension, so a text is scored in time linear in its inputs.

The machine is trained in numpy on the driver, on the inputs of a bounded sample of
labelled documents; inputs are made, and texts scored, in the tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.arrow import field, free_names, with_text_columns

#: Labelled documents of each class that are learned from. With BUCKETS they bound
#: what the driver holds. Scoring has no such bound.
SAMPLE_ROWS = 3000
THRESHOLD = 0.3

BUCKETS = 1 << 14
FACTORS = 8
RANGES = 8  # of a statistic; one more stands for unknown values
EPOCHS, PATIENCE, BATCH, RATE = 20, 3, 64, 0.02
DECAY = 1e-4
CHECKED = 5  # one of so many sampled documents is kept to end training
GOOD_SHARE = 0.5  # weight of label 1, however many there are
REMEMBERED = 200_000  # words per task

_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256)
)
_CLASSES = {
    "upper": [b for b in range(65, 91)],
    "lower": [b for b in range(97, 123)],
    "digit": [b for b in range(48, 58)],
    "blank": [9, 10, 11, 12, 13, 32],
    "comma": list(b".,;:"),
    "call": list(b"!?"),
    "quote": list(b"'\"()-"),
    "bar": list(b"|"),
    "tag": list(b"<>{}[]=/\\_"),
    "symbol": list(b"#$%&*+@^`~"),
    "control": [b for b in (*range(9), *range(14, 32), 127)],
    "beyond": list(range(128, 256)),
}
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[_bytes, _i] = 1
STATISTICS = (
    *_CLASSES,
    "log_length",
    "log_words",
    "word_length",
    "distinct_words",
    "same_as_before",
    "top_word",
    "log_lines",
    "repeated_lines",
    "ended_lines",
    "entropy",
)


class Words:
    """Numbers and buckets of words, remembered by word."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.buckets = np.zeros(1024, np.int32)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """(number of each word, how many different ones)."""
        found = set(words)
        new = found.difference(self.rows)
        if len(self.rows) + len(new) > REMEMBERED:
            self.clear()
            new = found
        at = len(self.rows)
        while len(self.buckets) < at + len(new):
            self.buckets = np.concatenate([self.buckets, np.zeros_like(self.buckets)])
        for i, word in enumerate(new, at):
            self.rows[word] = i
            self.buckets[i] = zlib.crc32(word) % BUCKETS
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)), len(found)


def inputs_of(words: Words, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(buckets in ascending order, their values, statistics) of a whole text. Values
    are counts scaled to a length of one."""
    data = (text or "").encode()
    cut = data.translate(_WORDS).split()
    numbers, distinct = words.read(cut)
    buckets, counts = np.unique(words.buckets[numbers], return_counts=True)
    values = counts / max(np.sqrt((counts.astype(float) ** 2).sum()), 1)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = seen / max(len(data), 1)
    some = shares[shares > 0]
    lines = [line for line in data.split(b"\n") if line.strip()]
    n, n_lines = max(len(cut), 1), max(len(lines), 1)
    statistics = (shares @ _CLASS_OF).tolist() + [
        float(np.log1p(len(data))),
        float(np.log1p(len(cut))),
        (len(data) - seen[32]) / n,
        distinct / n,
        float((numbers[1:] == numbers[:-1]).sum()) / n,
        float(counts.max(initial=0)) / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / n_lines,
        sum(line.rstrip()[-1:] in b".!?" for line in lines) / n_lines,
        float(-(some * np.log2(some)).sum()),
    ]
    return buckets, values, statistics


class Machine:
    """Weights, vectors and the ranges of statistics."""

    def __init__(self, edges: list[np.ndarray], seed: int = 1):
        self.edges = edges
        size = BUCKETS + len(edges) * (RANGES + 1)
        draw = np.random.default_rng(seed)
        self.p = {
            "bias": np.zeros(1),
            "weight": np.zeros(size),
            "vector": draw.standard_normal((size, FACTORS)) * 0.02,
        }

    def ranges(self, statistics: np.ndarray) -> np.ndarray:
        """The input that stands for each statistic of each text."""
        columns = [
            np.where(np.isnan(column), RANGES, np.searchsorted(edges, column, "right"))
            + BUCKETS
            + i * (RANGES + 1)
            for i, (edges, column) in enumerate(zip(self.edges, statistics.T))
        ]
        return np.stack(columns, axis=1)

    def rows(self, made: list[tuple], statistics: np.ndarray) -> tuple[np.ndarray, ...]:
        """(inputs, values, start of each text) of texts; every text has its statistics."""
        fixed = self.ranges(statistics)
        one = np.ones(fixed.shape[1])
        inputs = np.concatenate([x for (b, _, *_), f in zip(made, fixed) for x in (b, f)])
        values = np.concatenate([x for (_, v, *_) in made for x in (v, one)])
        lengths = np.array([len(b) + fixed.shape[1] for b, *_ in made])
        return inputs, values, np.cumsum(lengths) - lengths

    def logits(self, inputs: np.ndarray, values: np.ndarray, starts: np.ndarray, keep: bool = False):
        """Sum of weights and of all pairs; with ``keep`` also the sums of vectors."""
        scaled = self.p["vector"][inputs] * values[:, None]
        total = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(1), starts)
        linear = np.add.reduceat(self.p["weight"][inputs] * values, starts)
        out = self.p["bias"][0] + linear + ((total * total).sum(1) - squares) / 2
        return (out, total) if keep else out

    def gradients(self, inputs, values, starts, errors: np.ndarray) -> tuple[np.ndarray, dict]:
        """(different inputs, gradients of their weights and vectors, and of the bias)
        where ``errors`` are the loss's gradients by the logits."""
        total = self.logits(inputs, values, starts, keep=True)[1]
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(inputs))))
        used, place = np.unique(inputs, return_inverse=True)
        by_weight = errors[own] * values
        by_vector = by_weight[:, None] * (total[own] - self.p["vector"][inputs] * values[:, None])
        vector = np.stack(
            [np.bincount(place, by_vector[:, f], len(used)) for f in range(FACTORS)], axis=1
        )
        return used, {
            "bias": errors.sum(keepdims=True),
            "weight": np.bincount(place, by_weight, len(used)),
            "vector": vector,
        }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def edges_of(statistics: np.ndarray) -> list[np.ndarray]:
    """The values that part each statistic into ranges of about equal numbers."""
    shares = np.arange(1, RANGES) / RANGES
    parts = []
    for column in statistics.T:
        known = column[~np.isnan(column)]
        parts.append(np.unique(np.quantile(known, shares)) if len(known) else np.zeros(0))
    return parts


def train(made: list[tuple], good: list[int], checked: list[bool], seed: int = 1) -> Machine:
    """A machine fitted to the inputs and labels of texts.

    Both classes weigh as GOOD_SHARE says. Training ends when the loss on the ``checked``
    texts, which are not learned from, has not fallen for PATIENCE rounds; the best
    round counts. With one class or none the machine scores every text alike.
    """
    statistics = np.array([m[2] for m in made], float) if made else np.zeros((0, 0))
    machine = Machine(edges_of(statistics), seed)
    y = np.array(good, float)
    if len(set(good)) < 2:
        return machine
    share = np.where(y > 0, GOOD_SHARE, 1 - GOOD_SHARE)
    weight = share * len(y) / np.where(y > 0, y.sum(), (1 - y).sum())
    held = np.array(checked, bool)
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    learned, kept = np.flatnonzero(~held), np.flatnonzero(held)

    def some(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        return machine.rows([made[i] for i in rows], statistics[rows])

    def loss() -> float:
        out = machine.logits(*some(kept))
        return float((weight[kept] * (np.logaddexp(0, out) - y[kept] * out)).sum())

    sums = {k: np.full(v.shape, 1e-8) for k, v in machine.p.items()}
    draw = np.random.default_rng(seed)
    best, best_loss, waited = None, np.inf, 0
    for _ in range(EPOCHS):
        order = draw.permutation(learned)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            batch = some(rows)
            errors = (_sigmoid(machine.logits(*batch)) - y[rows]) * weight[rows] / len(rows)
            used, gradient = machine.gradients(*batch, errors)
            for name, g in gradient.items():
                place = slice(None) if name == "bias" else used
                if name != "bias":
                    g = g + DECAY * machine.p[name][place]
                sums[name][place] += g * g
                machine.p[name][place] -= RATE * g / np.sqrt(sums[name][place])
        if len(kept):
            now = loss()
            if now < best_loss:
                best, best_loss, waited = {k: v.copy() for k, v in machine.p.items()}, now, 0
            elif (waited := waited + 1) >= PATIENCE:
                break
    machine.p = best or machine.p
    return machine


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _known(texts: list, *numbers: list) -> list[list[float]]:
    """The further numbers of each text, compressed; nan where unknown."""
    columns = [np.array([np.nan if v is None else v for v in column], float) for column in numbers]
    if not columns:
        return [[] for _ in texts]
    return np.stack([np.sign(c) * np.log1p(np.abs(c)) for c in columns], axis=1).tolist()


def _with_numbers(df: DataFrame, numbers: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``df`` with copies, as doubles, of the columns that scores read."""
    read = free_names(df, *(f"number{i}" for i in range(len(numbers))))
    copies = {r: F.col(n).cast("double") for r, n in zip(read, numbers)}
    return (df.withColumns(copies) if copies else df), read


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    numbers: tuple[str, ...] = (),
    sample_rows: int = SAMPLE_ROWS,
) -> Machine:
    """Trains on at most ``sample_rows`` labelled documents of each class, drawn by a
    hash of their ids, none held out; their texts are read whole in the tasks and
    only their inputs reach the driver.

    ``numbers`` names columns with numbers known about a document. A document that
    several labels name is good if all say so; null labels and ids count for nothing.
    Of several texts with one id the one of the least hash is learned.
    """
    known = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("good"))
        .where("doc_id is not null and good is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    drawn = known.where("good > 0").orderBy(*order).limit(sample_rows)
    drawn = drawn.unionByName(known.where("good <= 0").orderBy(*order).limit(sample_rows))
    own = [F.col(n).cast("double").alias(f"number{i}") for i, n in enumerate(numbers)]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *own)
    # the ids drawn are of bounded number
    sample = own.where("text is not null").join(F.broadcast(drawn), "doc_id")
    rest = F.struct("text", "good", *(f"number{i}" for i in range(len(numbers))))
    sample = sample.groupBy("doc_id").agg(
        F.min_by(rest, F.struct(F.xxhash64("text"), F.xxhash64(rest))).alias("row")
    )
    fields = [
        field("buckets", T.ArrayType(T.IntegerType())),
        field("values", T.ArrayType(T.DoubleType())),
        field("statistics", T.ArrayType(T.DoubleType())),
    ]

    def make():
        words = Words()

        def work(texts, *columns):
            made = [inputs_of(words, t) for t in texts]
            known = _known(texts, *columns)
            return zip(*((b, v, [*s, *k]) for (b, v, s), k in zip(made, known)))

        return work

    also = tuple(f"number{i}" for i in range(len(numbers)))
    rows = with_text_columns(sample.select("doc_id", "row.*"), "text", fields, make, also=also)
    rows = rows.select("doc_id", "good", *(f.name for f in fields)).collect()
    rows.sort(key=lambda r: r["doc_id"])
    made = [
        (np.array(r["buckets"], np.int64), np.array(r["values"]), r["statistics"]) for r in rows
    ]
    checked = [zlib.crc32(f"checked {r['doc_id']}".encode()) % CHECKED == 0 for r in rows]
    return train(made, [int(r["good"] > 0) for r in rows], checked)


def score_texts(machine: Machine, words: Words, texts: list, *numbers: list) -> list[float]:
    made = [inputs_of(words, t) for t in texts]
    if not machine.edges:  # nothing was learned
        return [float(_sigmoid(machine.p["bias"])[0])] * len(texts)
    statistics = np.array([[*m[2], *k] for m, k in zip(made, _known(texts, *numbers))])
    return _sigmoid(machine.logits(*machine.rows(made, statistics))).tolist()


def with_quality(
    docs: DataFrame,
    machine: Machine,
    text: str = "text",
    numbers: tuple[str, ...] = (),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 at ``threshold`` or above); columns
    of these names are replaced, but read first where ``numbers`` names them. Null and
    empty texts get the score of a text without words. Rows neither move nor go."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    ready, read = _with_numbers(docs, numbers)

    def make():
        words = Words()
        return lambda texts, *columns: [score_texts(shared.value, words, texts, *columns)]

    fields = [field("score", T.DoubleType())]
    scored = with_text_columns(ready, text, fields, make, also=tuple(read)).drop(*read)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
