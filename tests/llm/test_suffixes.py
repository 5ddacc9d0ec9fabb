import random
from collections import Counter

import pytest

from innsight.llm import suffixes
from innsight.llm.suffixes import remove_repeats


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in datas for p in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = []
        for k, g in enumerate(gone):
            if g and spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            elif g:
                spans.append([k, k + 1])
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def check(frame, texts, length):
    docs = frame(list(enumerate(texts)), clash=("row", "tag", "kept"))
    got = {r["doc_id"]: r for r in remove_repeats(docs, length=length).collect()}
    for doc_id, (size, removed, spans, kept) in enumerate(brute(texts, length)):
        row = got[doc_id]
        assert row["spans"] == spans, (doc_id, texts[doc_id][:80])
        assert (row["n_bytes"], row["n_removed"], bytes(row["kept"])) == (size, removed, kept)


@pytest.mark.parametrize("length,stretch", [(20, 1 << 17), (25, 64), (3, 50)])
def test_equals_brute_force(frame, monkeypatch, length, stretch):
    monkeypatch.setattr(suffixes, "STRETCH", stretch)
    draw = random.Random(length)
    word = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    shared = [word(n) for n in (length - 1, length, length + 1, 2 * length, 90, 300)]
    texts = [word(draw.randrange(0, 200)) + draw.choice(shared) + word(draw.randrange(100)) for _ in range(40)]
    texts += [shared[5], shared[5], shared[4] + shared[5], shared[3] * 2, "", None, "x" * 150, "xy" * 90]
    texts += ["z" * (length + 1), "q" * length, word(40) * 3, shared[5][50:250]]
    check(frame, texts, length)


def test_stretches_of_workers_use_the_default(frame):
    """A text longer than a stretch, with a repeat across the border."""
    draw = random.Random(1)
    text = "".join(chr(97 + draw.randrange(26)) for _ in range((1 << 17) + 900))
    inner = text[(1 << 17) - 300 : (1 << 17) + 500]
    docs = frame([(1, text), (2, "before " + inner + " after"), (3, text[:399])])
    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert got[1]["spans"] == [[(1 << 17) - 300, (1 << 17) + 500]]
    assert got[2]["spans"] == [[7, 807]] and got[3]["n_removed"] == 0


def test_awkward_rows(frame, awkward):
    rows = remove_repeats(frame(awkward)).collect()
    assert len(rows) == len(awkward)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["n_removed"] == by_id[4]["n_bytes"] > 0
    assert by_id[5]["n_removed"] == 30_000 and by_id[1]["n_bytes"] == 0
    assert remove_repeats(frame([])).count() == 0


def test_query_equals_brute_force(spark, contract, documents):
    import hashlib

    df = contract.queries()["op6_suffix_array"](spark, "/root/testdata/sf0.001")
    got = {r["doc_id"]: r for r in df.collect()}
    for (doc_id, _), (size, removed, spans, kept) in zip(documents, brute([t for _, t in documents], 400)):
        row = got[doc_id]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (size, removed, len(spans))
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()
