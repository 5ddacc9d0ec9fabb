import random
import re

import pytest
import xxhash

from innsight.llm.simhash import drop_near_duplicates, fingerprint, near_duplicates, near_pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42)
        for i in range(len(words) - n + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, doc_id in enumerate(ids):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint(documents):
    for _, text in documents[:60]:
        assert fingerprint(text) % 2**64 == plain(text)
    for text in ["", "One", "one two\x0bTHREE", "É é x y z", "a b c d", "a b c d e"]:
        assert fingerprint(text) % 2**64 == plain(text)


@pytest.mark.parametrize("max_bits,segments", [(4, 3), (4, 4), (5, 2), (0, 3)])
def test_pairs_equal_brute_force(spark, max_bits, segments):
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for value in list(prints)[:40]:
        for bits in (1, 2, 3, 4, 5, 6):
            near = value
            for bit in draw.sample(range(64), bits):
                near ^= 1 << bit
            prints.add(near)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    got = sorted(map(tuple, near_pairs(df, max_bits, segments).collect()))
    expected = sorted(
        (a, b)
        for a in signed
        for b in signed
        if a < b and ((a ^ b) % 2**64).bit_count() <= max_bits
    )
    assert got == expected


def test_query_equals_brute_force(spark, contract, documents):
    df = contract.queries()["op5_simhash"](spark, "/root/testdata/sf0.001")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}
    prints = [plain(t) for _, t in documents]
    roots = components(prints, [i for i, _ in documents])
    for (doc_id, _), value, root in zip(documents, prints, roots):
        assert got[doc_id] == (f"{value:016x}", root)


def test_awkward_rows(frame, awkward):
    docs = frame(awkward, clash=("fingerprint", "component_id", "row_hash"))
    rows = near_duplicates(docs).collect()
    prints = [plain(t) for _, t in awkward]
    roots = components(prints, [i for i, _ in awkward])
    key = lambda r: tuple(map(str, r))
    got = sorted(((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in rows), key=key)
    assert got == sorted(((i, p, r) for (i, _), p, r in zip(awkward, prints, roots)), key=key)
    assert near_duplicates(frame([])).count() == 0


def test_one_document_of_each_group_stays(frame, awkward):
    names = ("component_id", "__hash", "row_hash", "ROW_CHECK", "row_number", "fingerprint")
    docs = frame(awkward, clash=names)
    assert all(r[n] == "x" for r in drop_near_duplicates(docs).collect() for n in names)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    prints = [plain(t) for _, t in awkward]
    group = dict(zip([(i, t) for i, t in awkward], components(prints, list(range(len(awkward))))))
    assert len(rows) == len({group[r] for r in rows}) == len(set(group.values()))
    assert (1, None) in rows and rows.count((4, awkward[3][1])) == 1
    assert drop_near_duplicates(frame([])).count() == 0
