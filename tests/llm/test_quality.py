import zlib

import duckdb
import numpy as np
import pytest

from innsight.llm import quality as M


def machine_of(seed=3):
    machine = M.Machine([np.array([0.0, 1.0]), np.array([])], seed)
    draw = np.random.default_rng(seed)
    for k, v in machine.p.items():
        machine.p[k] = draw.standard_normal(v.shape) * 0.5
    return machine


def rows_of(machine):
    made = [
        (np.array([3, 8, 9]), np.array([0.2, 0.5, 0.7])),
        (np.zeros(0, np.int64), np.zeros(0)),
        (np.array([8]), np.array([1.0])),
    ]
    return machine.rows(made, np.array([[0.5, 7.0], [np.nan, -1.0], [5.0, np.nan]]))


def pairwise(machine, inputs, values, starts):
    """Every pair by itself."""
    found = []
    for a, b in zip(starts, [*starts[1:], len(inputs)]):
        total = machine.p["bias"][0]
        for i in range(a, b):
            total += machine.p["weight"][inputs[i]] * values[i]
            for j in range(i + 1, b):
                both = machine.p["vector"][inputs[i]] @ machine.p["vector"][inputs[j]]
                total += both * values[i] * values[j]
        found.append(total)
    return found


def test_sum_of_squares_equals_all_pairs():
    machine = machine_of()
    rows = rows_of(machine)
    assert machine.logits(*rows) == pytest.approx(pairwise(machine, *rows), abs=1e-9)


def test_gradients_equal_differences():
    machine = machine_of()
    inputs, values, starts = rows_of(machine)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        out = machine.logits(inputs, values, starts)
        return float((np.logaddexp(0, out) - y * out).sum())

    errors = 1 / (1 + np.exp(-machine.logits(inputs, values, starts))) - y
    used, gradient = machine.gradients(inputs, values, starts, errors)
    for name, g in gradient.items():
        for place, i in enumerate([0] if name == "bias" else used):
            for f in range(M.FACTORS) if name == "vector" else [()]:
                at = (i, f) if name == "vector" else i
                kept = machine.p[name][at]
                machine.p[name][at] = kept + 1e-5
                high = loss()
                machine.p[name][at] = kept - 1e-5
                low = loss()
                machine.p[name][at] = kept
                own = g[place, f] if name == "vector" else g[place]
                assert own == pytest.approx((high - low) / 2e-5, abs=1e-6)


def test_pairs_learn_what_single_inputs_cannot():
    """Good is one of two words, not both and not none."""
    draw = np.random.default_rng(5)
    words = M.Words()
    made, good = [], []
    for _ in range(900):
        a, b = draw.integers(0, 2, 2)
        text = " ".join(["tea"] * a + ["sun"] * b + ["rain"])
        made.append(M.inputs_of(words, text)[:2] + ([0.0],))
        good.append(int(a != b))
    machine = M.train(made, good, [False] * len(good))
    scores = M._sigmoid(machine.logits(*machine.rows(made, np.zeros((len(made), 1)))))
    assert np.mean((scores > 0.5) == (np.array(good) > 0)) > 0.95


def test_query_on_held_out_labels(spark, contract):
    folder = "/root/testdata/sf0.01"
    rows = contract.queries()["op11_quality"](spark, folder).collect()
    duck = duckdb.connect()
    labels = dict(duck.execute(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    scored = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = np.array([s for s, q in scored if q])
    bad = np.array([s for s, q in scored if not q])
    assert np.mean([(good > b).mean() for b in bad]) > 0.95
    assert (good >= 0.3).mean() > 0.95 and (bad < 0.3).mean() > 0.6


def test_stored_scores_equal_all_pairs(spark, frame, prose):
    rows = [(i, prose(5 + i) + (" | ###" * 9 if i % 2 else ".")) for i in range(60)]
    docs = frame(rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    machine = M.fit(docs, labels)
    words = M.Words()
    for r in M.with_quality(docs, machine).collect():
        buckets, values, statistics = M.inputs_of(words, r["text"])
        one = machine.rows([(buckets, values)], np.array([statistics]))
        logit = pairwise(machine, *one)[0]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)
        assert r["predicted"] == 1 - r["doc_id"] % 2


def test_awkward_rows_and_labels(spark, frame, awkward):
    docs = frame(awkward, clash=("score", "predicted", "quality", "number0", "good", "Row"))
    docs = docs.withColumn("n_chars", docs.doc_id * 7)
    labels = spark.createDataFrame(
        [(4, 1), (4, 0), (6, 1), (5, None), (None, 1), (77, 1), (1, 0), (2, 0), (3, 1)],
        "doc_id long, quality int",
    )
    for numbers in ((), ("n_chars",), ("n_chars", "number0")):
        if "number0" in numbers:
            docs = docs.withColumn("number0", docs.doc_id.cast("double"))
        machine = M.fit(docs, labels, numbers=numbers)
        rows = M.with_quality(docs, machine, numbers=numbers).collect()
        assert len(rows) == len(awkward) and all(0 <= r["score"] <= 1 for r in rows)
        assert {"number0", "Row", "good"} < set(rows[0].asDict())
    machine = M.fit(docs, labels)
    rows = M.with_quality(docs, machine).collect()
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    none = M.fit(docs, labels.where("false"))
    assert {r["score"] for r in M.with_quality(docs, none).collect()} == {0.5}
    assert M.with_quality(frame([]), machine).count() == 0
    again = M.fit(docs.repartition(5), labels)
    assert all((again.p[k] == machine.p[k]).all() for k in machine.p)
