"""Toxicity scores by a bidirectional gated recurrent network over words.

Each word enters as a learned vector of its hash and a learned mean of its
character pairs. Two gated recurrent layers read a window of words from both ends,
attention pools their states and a linear layer gives the window's score. All
overlapping windows of a text are scored; the highest counts, so one bad passage
of a long text is enough.

The network is trained in numpy on the driver, on a bounded sample of labelled
documents; every text is scored in the tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.llm.arrow import field, with_text_columns

#: Labelled documents of each class that are learned from, and the most characters
#: of one; they bound what the driver holds. Scoring has no such bound.
SAMPLE_ROWS = 2500
SAMPLE_CHARS = 30_000
THRESHOLD = 0.3

WINDOW, STRIDE = 32, 16
LETTERS = 16  # bytes of a word; longer words are cut into several
BUCKETS, PAIRS = 1 << 15, 1 << 12
WORD_SIZE, PAIR_SIZE, HIDDEN = 12, 8, 8
INPUT = WORD_SIZE + PAIR_SIZE
EPOCHS, BATCH, RATE = 8, 64, 0.01
PRIOR = 3  # texts that every word counts as seen in
SELDOM = 5  # texts with a word that let half of its odds count
LEAST_TEXTS = 5  # with a word that has a vector of its own
DROPPED = 0.3  # of the learned numbers of a word, in training
TOXIC_SHARE = 0.3
REMEMBERED = 100_000  # words per task
AT_ONCE = 1024  # windows

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation, in parts of LETTERS bytes."""
    words = text.encode().translate(_FOLD).split()
    if words and max(map(len, words)) > LETTERS:
        words = [w[i : i + LETTERS] for w in words for i in range(0, len(w), LETTERS)]
    return words


def letters(words: list[bytes]) -> np.ndarray:
    return np.array(words, f"S{LETTERS}").view(np.uint8).reshape(-1, LETTERS)


def buckets(matrix: np.ndarray) -> np.ndarray:
    """Hash of each word, below BUCKETS."""
    parts = np.ascontiguousarray(matrix).view("<u8")
    mixed = parts[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ parts[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(49)).astype(np.int32)


def pairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's character pairs, the first with the word's start, and
    their shares; places behind the word have the share 0."""
    before = np.concatenate([np.ones((len(matrix), 1), np.uint8), matrix[:, :-1]], axis=1)
    codes = (before.astype(np.int32) * 257 + matrix) * 40503 >> 4 & (PAIRS - 1)
    there = matrix > 0
    shares = there / np.maximum(there.sum(1, keepdims=True), 1)
    return codes, shares.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, and the scores of windows of word inputs."""

    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": normal(BUCKETS, WORD_SIZE, scale=0.05),
            "pair": normal(PAIRS, PAIR_SIZE, scale=0.05),
            # gates (update, reset, new) of the forward, then of the backward layer
            "into": normal(INPUT, 6 * HIDDEN, scale=INPUT**-0.5),
            "shift": np.zeros(6 * HIDDEN, np.float32),
            "across0": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "across1": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "look": normal(2 * HIDDEN, scale=0.1),
            "out": normal(2 * HIDDEN, scale=0.3),
            "bias": np.full(1, -1.0, np.float32),
        }

    def inputs(self, bucket: np.ndarray, codes: np.ndarray, shares: np.ndarray) -> np.ndarray:
        letters_mean = np.einsum("nl,nlk->nk", shares, self.p["pair"][codes])
        return np.concatenate([self.p["word"][bucket], letters_mean], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["into"] + self.p["shift"]

    def _layer(self, gates: np.ndarray, mask: np.ndarray, side: int, keep: list | None):
        """States of one layer; ``gates`` has a window's inputs on axis 1."""
        h = np.zeros((len(gates), HIDDEN), np.float32)
        across = self.p[f"across{side}"]
        states = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        order = range(gates.shape[1]) if side == 0 else range(gates.shape[1] - 1, -1, -1)
        for t in order:
            g, u = gates[:, t], h @ across
            zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            there = mask[:, t, None]
            new = h + there * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * HIDDEN :], there))
            h = states[:, t] = new
        return states

    def pooled(self, gates: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None):
        """(logits, attention, states, pooled state) of windows."""
        half = 3 * HIDDEN
        keep = keep or (None, None)
        states = np.concatenate(
            [
                self._layer(gates[..., :half], mask, 0, keep[0]),
                self._layer(gates[..., half:], mask, 1, keep[1]),
            ],
            axis=2,
        )
        looked = np.where(mask > 0, states @ self.p["look"], -1e9)
        looked = np.exp(looked - looked.max(1, keepdims=True)) * mask
        attention = looked / np.maximum(looked.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", attention, states)
        return pooled @ self.p["out"] + self.p["bias"][0], attention, states, pooled

    def gradients(self, x: np.ndarray, mask: np.ndarray, error) -> tuple[dict, np.ndarray]:
        """Gradients of the shared parameters and of the inputs ``x`` (windows, words,
        INPUT); ``error`` gives the loss's gradient by the logits."""
        keep = ([], [])
        logits, attention, states, pooled = self.pooled(self.gates(x), mask, keep)
        d = error(logits).astype(np.float32)
        p, g = self.p, {}
        g["out"], g["bias"] = d @ pooled, d.sum(keepdims=True)
        d_pooled = d[:, None] * p["out"]
        d_attention = np.einsum("bh,bth->bt", d_pooled, states)
        d_looked = attention * (d_attention - (attention * d_attention).sum(1, keepdims=True))
        g["look"] = np.einsum("bt,bth->h", d_looked, states)
        d_states = attention[..., None] * d_pooled[:, None] + d_looked[..., None] * p["look"]
        d_gates = np.zeros((*x.shape[:2], 6 * HIDDEN), np.float32)
        for side in (0, 1):
            across, at = p[f"across{side}"], side * 3 * HIDDEN
            g[f"across{side}"] = np.zeros_like(across)
            d_h = np.zeros((len(x), HIDDEN), np.float32)
            for t, h, z, r, n, u, there in reversed(keep[side]):
                d_new = d_h + d_states[:, t, side * HIDDEN : (side + 1) * HIDDEN]
                moved = d_new * there
                d_n = moved * (1 - z) * (1 - n * n)
                d_z = moved * (h - n) * z * (1 - z)
                d_r = d_n * u * r * (1 - r)
                d_gates[:, t, at : at + 3 * HIDDEN] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g[f"across{side}"] += h.T @ d_u
                d_h = d_new * (1 - there) + moved * z + d_u @ across.T
        flat = d_gates.reshape(-1, 6 * HIDDEN)
        g["into"], g["shift"] = x.reshape(-1, INPUT).T @ flat, flat.sum(0)
        return g, d_gates @ p["into"].T


class Words:
    """Input gates of words, remembered by word; row 0 stands for no word."""

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.rows))
        if len(self.rows) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        at = len(self.rows) + 1
        while len(self.gates) < at + len(new):
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
        for start in range(0, len(new), AT_ONCE):
            some = new[start : start + AT_ONCE]
            matrix = letters(some)
            x = self.network.inputs(buckets(matrix), *pairs(matrix))
            self.gates[at + start : at + start + len(some)] = self.network.gates(x)
        self.rows.update(zip(new, range(at, at + len(new))))


def window_starts(n: int) -> np.ndarray:
    """Starts of windows that overlap by half and reach the end of ``n`` words."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else np.zeros(1, int)


def windows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word rows of all windows, place of each text's first window). A text without
    words has one window of none."""
    lengths = np.array([len(r) for r in rows])
    padded = np.zeros(int(lengths.sum()) + len(rows) * WINDOW, np.int32)
    starts, first, at, count = [], [], 0, 0
    for r in rows:
        padded[at : at + len(r)] = r
        own = window_starts(len(r))
        first.append(count)
        starts.append(own + at)
        count += len(own)
        at += len(r) + WINDOW
    return padded[np.concatenate(starts)[:, None] + np.arange(WINDOW)], np.array(first)


def score_texts(network: Network, words: Words, texts: list[str | None]) -> list[float]:
    cut = [words_of(t or "") for t in texts]
    words.learn(set().union(*cut))
    index = words.rows.__getitem__
    rows = [np.fromiter(map(index, c), np.int32, len(c)) for c in cut]
    ids, first = windows(rows)
    logits = np.empty(len(ids), np.float32)
    for at in range(0, len(ids), AT_ONCE):
        some = ids[at : at + AT_ONCE]
        logits[at : at + AT_ONCE] = network.pooled(
            words.gates[some], (some > 0).astype(np.float32)
        )[0]
    best = np.maximum.reduceat(logits, first).astype(np.float64)
    return (1 / (1 + np.exp(-best))).tolist()


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network fitted to labelled texts, by their best window of each epoch.

    The first number of a word vector starts as how much likelier the word is in
    toxic texts; all numbers are then learned, but for words of few texts, which have
    none of their own. The classes weigh as TOXIC_SHARE says, whatever their numbers,
    and a text without words is learned as not toxic.
    """
    network = Network(seed)
    if not texts:
        return network
    texts, toxic = [*texts, ""], [*toxic, 0]
    y = np.array(toxic, np.float32)
    share = np.where(y > 0, TOXIC_SHARE, 1 - TOXIC_SHARE)
    weight = share * len(y) / np.where(y > 0, max(y.sum(), 1), max((1 - y).sum(), 1))
    cut = [words_of(t or "") for t in texts]
    names = {w: i + 1 for i, w in enumerate(sorted(set().union(*cut)))}
    rows = [np.array([names[w] for w in c], np.int32) for c in cut]
    del cut
    matrix = letters([b"", *names])
    bucket, (codes, shares) = buckets(matrix), pairs(matrix)
    counts = np.zeros((2, BUCKETS))
    for r, label in zip(rows, toxic):
        counts[int(label > 0), np.unique(bucket[r])] += 1
    # a word counts as seen in PRIOR more texts of the usual share, and the fewer texts
    # it is in, the less its odds say
    seen, usual = counts.sum(0), max(y.sum(), 1) / len(y)
    odds = np.log((counts[1] + PRIOR * usual) / (counts[0] + PRIOR * (1 - usual)))
    odds -= np.log(usual / (1 - usual))
    network.p["word"][:, 0] = np.clip(odds * seen / (seen + SELDOM), -3, 3)
    # what few texts hold would only teach which texts these are
    rare = seen < LEAST_TEXTS
    network.p["word"][rare] = 0

    ids, first = windows(rows)
    last = np.append(first[1:], len(ids))
    draw = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    sums, averaged = {k: np.zeros(v.shape) for k, v in network.p.items()}, 0
    for epoch in range(epochs):
        gates = np.concatenate(
            [
                network.gates(
                    network.inputs(bucket[a : a + AT_ONCE], codes[a : a + AT_ONCE], shares[a : a + AT_ONCE])
                )
                for a in range(0, len(bucket), AT_ONCE)
            ]
        )
        logits = np.concatenate(
            [
                network.pooled(gates[w], (w > 0).astype(np.float32))[0]
                for w in (ids[a : a + AT_ONCE] for a in range(0, len(ids), AT_ONCE))
            ]
        )
        best = np.array([a + np.argmax(logits[a:b]) for a, b in zip(first, last)])
        order = draw.permutation(len(best))
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            some = ids[best[chosen]]
            mask = (some > 0).astype(np.float32)
            used, place = np.unique(some, return_inverse=True)
            x_used = network.inputs(bucket[used], codes[used], shares[used])
            # what single texts teach about single words must not be relied on
            kept_inputs = (draw.random(x_used.shape) >= DROPPED) / (1 - DROPPED)
            kept_inputs[:, 0] = 1
            x_used = (x_used * kept_inputs).astype(np.float32)
            x = x_used[place.reshape(some.shape)]

            def error(logits, chosen=chosen):
                return (_sigmoid(logits) - y[chosen]) * weight[chosen] / len(chosen)

            g, d_x = network.gradients(x, mask, error)
            d_used = np.zeros_like(x_used)
            np.add.at(d_used, place.ravel(), d_x.reshape(-1, INPUT))
            d_used *= kept_inputs
            d_used[used == 0] = 0
            g["word"] = np.zeros_like(network.p["word"])
            np.add.at(g["word"], bucket[used], d_used[:, :WORD_SIZE])
            g["word"][rare] = 0
            g["pair"] = np.zeros_like(network.p["pair"])
            spread = shares[used][..., None] * d_used[:, None, WORD_SIZE:]
            np.add.at(g["pair"], codes[used].ravel(), spread.reshape(-1, PAIR_SIZE))
            step += 1
            _adam(network.p, g, moments, step)
            if 2 * epoch >= epochs:
                for k, v in network.p.items():
                    sums[k] += v
                averaged += 1
    # the mean over the later steps hangs less on the order of the texts than the last
    for k, v in sums.items():
        network.p[k] = (v / averaged).astype(np.float32)
    return network


def _adam(p: dict, g: dict, moments: dict, step: int) -> None:
    for k, d in g.items():
        if k in ("word", "pair"):  # rows without gradient rest
            at = np.flatnonzero(np.abs(d).sum(1))
        else:
            at = slice(None)
        m, v = moments[k]
        m[at] = 0.9 * m[at] + 0.1 * d[at]
        v[at] = 0.999 * v[at] + 0.001 * d[at] ** 2
        scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        p[k][at] -= scale * m[at] / (np.sqrt(v[at]) + 1e-7)


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
) -> Network:
    """Trains on at most ``sample_rows`` labelled documents of each class, drawn by a
    hash of their ids, none held out, none of more than ``sample_chars``.

    A document that several labels name is toxic if one says so; null labels and
    ids count for nothing. Of several texts with one id the one of the least hash is
    learned. Without any labelled document the network is untrained
    and scores everything alike low.
    """
    known = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    drawn = known.where("toxic > 0").orderBy(*order).limit(sample_rows)
    drawn = drawn.unionByName(known.where("toxic <= 0").orderBy(*order).limit(sample_rows))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.where(F.col("text").isNotNull() & (F.char_length("text") <= sample_chars))
    # the ids drawn are of bounded number, the texts of bounded length
    sample = own.join(F.broadcast(drawn), "doc_id").groupBy("doc_id")
    sample = sample.agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in sample.collect())
    return train([r[1] for r in rows], [int(r[2] > 0) for r in rows])


def with_toxicity(
    docs: DataFrame, network: Network, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 at ``threshold`` or above);
    columns of these names are replaced. Null and empty texts get the score of a
    window without words. Rows neither move nor go."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        words = Words(shared.value)
        return lambda texts: [score_texts(shared.value, words, texts)]

    scored = with_text_columns(docs, text, [field("score", T.DoubleType())], make)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
