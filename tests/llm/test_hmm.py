import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from innsight.llm import hmm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def model(seed=0):
    draw = np.random.default_rng(seed)
    return hmm.Model.from_counts(
        draw.random(hmm.STATES), draw.random((hmm.STATES, hmm.STATES)), draw.random((hmm.STATES, hmm.CLASSES + 1))
    )


def forward(m, seen):
    state = m.start * m.emit[:, seen[0]]
    total = 0.0
    for c in seen[1:]:
        total += math.log(state.sum())
        state = (state / state.sum()) @ m.move * m.emit[:, c]
    return total + math.log(state.sum())


def sequences():
    draw = np.random.default_rng(4)
    return [draw.integers(0, hmm.CLASSES + 1, n).astype(np.uint16) for n in (1, 5, 3, 5, 40, 2, 1)]


def test_likelihoods_equal_plain_recursion():
    m, texts = model(), sequences()
    assert hmm.log_likelihoods(m, texts) == pytest.approx([forward(m, t) for t in texts])


def test_probabilities_of_all_sequences_of_a_length_add_up():
    m = model(3)
    pairs = [np.array([a, b], np.uint16) for a in range(0, hmm.CLASSES + 1, 97) for b in range(0, 4097, 89)]
    direct = [
        sum(
            m.start[i] * m.emit[i, a] * m.move[i, j] * m.emit[j, b]
            for i in range(hmm.STATES)
            for j in range(hmm.STATES)
        )
        for a, b in (p.tolist() for p in pairs[:50])
    ]
    assert np.exp(hmm.log_likelihoods(m, pairs[:50])) == pytest.approx(direct)


def test_expected_counts_equal_forward_backward():
    m, texts = model(), sequences()
    start, moves, emissions = hmm.expected_counts(m, texts)
    s, mv, em = np.zeros_like(start), np.zeros_like(moves), np.zeros_like(emissions)
    for seen in (t.tolist() for t in texts):
        n = len(seen)
        alpha = [m.start * m.emit[:, seen[0]]]
        for c in seen[1:]:
            alpha.append(alpha[-1] @ m.move * m.emit[:, c])
        beta = [np.ones(hmm.STATES)]
        for c in seen[:0:-1]:
            beta.insert(0, m.move @ (m.emit[:, c] * beta[0]))
        total = alpha[-1].sum()
        for t in range(n):
            gamma = alpha[t] * beta[t] / total
            em[:, seen[t]] += gamma
            s += gamma if t == 0 else 0
            if t:
                mv += np.outer(alpha[t - 1], m.emit[:, seen[t]] * beta[t]) * m.move / total
    assert start == pytest.approx(s) and moves == pytest.approx(mv)
    assert emissions == pytest.approx(em)


@pytest.mark.parametrize("n, at_once", [(1, 1), (5, 1), (40, 7), (40, 40), (41, 40), (300, 64)])
def test_long_texts_lose_nothing_where_stretches_meet(n, at_once):
    m, draw = model(5), np.random.default_rng(n)
    text = draw.integers(0, hmm.CLASSES + 1, n).astype(np.uint16)
    whole = hmm.expected_counts(m, [text])
    for a, b in zip(whole, hmm.expected_counts_of_long(m, text, at_once)):
        assert a == pytest.approx(b, abs=1e-12)


def plain_mixture(texts):
    """Part by part and text by text."""
    k, size = hmm.STATES, hmm.CLASSES + 1
    share = []
    for t in texts:
        own = zlib.crc32(t.tobytes()) % k
        share.append([float(i == own) for i in range(k)])
    for turn in range(hmm.MIXTURE_PASSES + 1):
        emit = np.zeros((k, size))
        for t, s in zip(texts, share):
            for c in t:
                emit[:, c] += s
        weights = np.sum(share, axis=0)
        if turn == hmm.MIXTURE_PASSES:
            return weights, emit
        logs = np.log((emit + 0.05) / (emit + 0.05).sum(1, keepdims=True))
        share = []
        for t in texts:
            log = logs[:, t].sum(1) + np.log((weights + 1e-6 * (1 + weights.sum())) / (1 + weights.sum()))
            p = np.exp(log - log.max())
            share.append(p / p.sum())


@pytest.mark.parametrize("at_once", [250_000, 9])
def test_score_from_end_to_end(frame, prose, monkeypatch, at_once):
    """The whole computation again, with a plain recursion for every text."""
    monkeypatch.setattr(hmm, "LEARNED_AT_ONCE", at_once)
    rows = [(i, f"{prose(3 + i % 23)} w{i} Rare{i % 7}") for i in range(70)] + [(90, None), (91, ""), (91, "")]
    got = sorted((r["doc_id"], r["score"]) for r in hmm.score_texts(frame(rows), frequent=9).collect())
    training = [t for d, t in rows if not held_out(d)]
    coded = lambda t: [hmm.class_of(w.encode()) for w in words_of(t)] + [hmm.END]
    texts = [np.array(coded(t), np.uint16) for t in training]
    m = hmm.Model.first(*plain_mixture(texts))
    for _ in range(hmm.PASSES):
        counts = [hmm.expected_counts(m, [t]) for t in texts]
        m = hmm.Model.from_counts(*(sum(c[i] for c in counts) for i in range(3)))
    words = Counter(w for t in training for w in words_of(t))
    size = Counter()
    kinds = Counter()
    for w, n in words.items():
        size[hmm.class_of(w.encode())] += n
        kinds[hmm.class_of(w.encode())] += 1
    expected = []
    for doc_id, text in rows:
        own = words_of(text)
        score = forward(m, coded(text)) / math.log(10)
        for w in own:
            c = hmm.class_of(w.encode())
            room = size[c] + 0.5 * (kinds[c] + 1) if kinds[c] else 0.5
            score += math.log10((words[w] + 0.5) / room)
        expected.append((doc_id, score))
    # the end is the only word of its class
    assert [d for d, _ in got] == sorted(d for d, _ in rows)
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(expected)], rel=1e-6)


def test_a_pass_raises_the_likelihood():
    texts = sequences()
    m = model()
    for _ in range(4):
        counts = hmm.expected_counts(m, texts)
        better = hmm.Model(
            counts[0] / counts[0].sum(),
            counts[1] / counts[1].sum(1, keepdims=True),
            counts[2] / counts[2].sum(1, keepdims=True),
        )
        assert hmm.log_likelihoods(better, texts).sum() > hmm.log_likelihoods(m, texts).sum()
        m = better


def base(rows, out):
    counts, ends = Counter(), 0
    for doc_id, text in rows:
        if not out(doc_id):
            counts.update(words_of(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    floor = math.log10(n + 0.5 * (v + 1))
    made = {}
    for doc_id, text in rows:
        words = words_of(text)
        score = sum(math.log10(counts[w] + 0.5) - floor for w in words) + math.log10(ends + 0.5) - floor
        made[doc_id] = (out(doc_id), len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), n, score)
    return made


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def test_query(spark, contract, documents):
    df = contract.queries()["op7_hidden_markov"](spark, "/root/testdata/sf0.001")
    got = {r["doc_id"]: r for r in df.collect()}
    made = base(documents, held_out)
    for doc_id, (out, n_tokens, n_known, n, score) in made.items():
        row = got[doc_id]
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (out, n_tokens, n_known, n)
        assert row["base_score"] == pytest.approx(score, rel=1e-9)
        assert row["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_rare_words_are_joined_alike(frame, awkward, frequent):
    docs = frame(awkward, clash=("row", "word", "classes"))
    rows = hmm.score_texts(docs, frequent=frequent, passes=1).collect()
    assert len(rows) == len(awkward)
    made = base(awkward, held_out)
    for row in rows:
        if row["doc_id"] in (1, 2, 3, 4, 5):
            out, n_tokens, n_known, n, score = made[row["doc_id"]]
            assert (row["n_tokens"], row["train_tokens"]) == (n_tokens, n)
            assert row["base_score"] == pytest.approx(score)
    scores = {r["doc_id"]: r["score"] for r in rows}
    again = hmm.score_texts(docs, frequent=5, passes=1).collect()
    assert {r["doc_id"]: r["score"] for r in again} == pytest.approx(scores)


def test_empty_and_nothing_to_learn_from(spark, frame):
    from pyspark.sql import functions as F

    assert hmm.score_texts(frame([])).count() == 0
    rows = hmm.score_texts(frame([(1, "a b"), (2, None)]), learn=F.lit(False), passes=1).collect()
    assert len(rows) == 2 and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert all(math.isfinite(r["score"]) for r in rows)
