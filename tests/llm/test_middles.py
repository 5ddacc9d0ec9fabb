import hashlib
import random
import re

import numpy as np
import pytest

from innsight.llm import middles as M


def plain_form(doc_id, text, rate=100, suffix_first=50):
    """The contract, written with a list of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("error", [0, 1, 7, 32, 200])
def test_index_is_exact_and_bounded(error):
    draw = random.Random(error)
    for n in (0, 1, 2, 63, 64, 65, 700, 5000):
        steps = [draw.choice((1, 1, 2, 40, 41, 900)) for _ in range(n)]
        offsets = np.cumsum([0, *steps])
        index = M.RankIndex(offsets, error)
        ranks = np.arange(len(offsets))
        assert (index.offsets(ranks) == offsets).all()
        assert (np.abs(offsets - index.predict(ranks)) <= error + 1).all()
        assert len(index.starts) <= len(offsets)
    # lines of one length need one segment
    even = np.arange(0, 8000, 8)
    assert len(M.RankIndex(even, error).starts) == 1


def test_ends_are_code_points():
    for text in ("", "\n", "a\n\nb", "äöü\n😀x\r\n\n漢", "no end"):
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert M.line_ends(text).tolist() == np.cumsum([0, *map(len, lines)]).tolist()


def test_query_equals_the_contract(spark, contract, documents):
    rows = contract.queries()["op12_fill_in_middle"](spark, "/root/testdata/sf0.001").collect()
    got = sorted(tuple(r) for r in rows)
    expected = []
    for doc_id, text in documents:
        n, form, a, b, output = plain_form(doc_id, text)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (output, text or "")]
        expected.append((doc_id, n, form, a, b, *digests))
    assert got == sorted(expected)


@pytest.mark.parametrize("rate, suffix_first", [(100, 50), (30, 0), (100, 100), (0, 50)])
def test_awkward_rows(frame, awkward, rate, suffix_first):
    rows = [
        *awkward,
        (7, "a<P>b\n"),
        (8, "one\n<S"),
        (9, "<\nP>\n<M\n>"),
        (10, "\n" * 3000),
        (11, "äß\r\n漢字\n😀\n" * 999),
        (12, "<M"),
    ]
    df = frame(rows, clash=("form", "n", "output", "draw1", "READ", "n_segments"))
    made = M.fill_in_middle(df, rate=rate, suffix_first=suffix_first)
    assert {"draw1", "READ", "output"} < set(made.columns)
    made = made.withColumn("back", M.restored(made.output, made.form)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    expected = [(d, *plain_form(d, t, rate, suffix_first), t or "") for d, t in rows]
    got = [
        (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made
    ]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert all(r.draw1 == r.READ == "x" for r in made)
    assert M.fill_in_middle(frame([])).count() == 0
