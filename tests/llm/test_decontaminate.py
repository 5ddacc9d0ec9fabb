import re

import pytest

from innsight.llm.decontaminate import find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window):
    words = WORD.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for item, item_text in items:
        own = WORD.findall((item_text or "").translate(LOWER))
        n = min(window, len(own))
        if item is None or not n:
            continue
        for i in range(len(own) - n + 1):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == own[i : i + n]:
                    hit.update(range(k, k + n))
                    names.add(str(item))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_equals_brute_force(spark, frame, shard_bytes):
    items = [(10, "Red tea, blue TREE!"), (9, "sun-moon"), (9, "the tea tree"), (2, ""), (3, None), (None, "x y")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        "I see red tea, blue tree; red   tea blue tree green",
        "sun moon sun\tmoon sun", "SUN.MOON", "the tea the tea tree", "Été sun moon É", None, "",
        "the tea tree " * 50, "blue tree red tea", "x y",
    ]
    docs = frame(list(enumerate(texts)), clash=("n_hit", "items", "n_words", "__hits", "one", "TWO", "found_items"))
    found = find_contamination(docs, benchmark, window=3, shard_bytes=shard_bytes)
    for row in found.collect():
        n_words, n_hit, names = brute(row["text"], items, 3)
        assert (row["n_words"], row["n_hit"], row["items"]) == (n_words, n_hit, names)
        assert row["contaminated"] == (n_hit > 0 and 20 * n_hit >= n_words)
        assert row["__hits"] == row["one"] == row["TWO"] == row["found_items"] == "x"
        inside = " ".join(row["text"][a:b] for a, b in row["hit_spans"])
        assert len(WORD.findall(inside.translate(LOWER))) == n_hit


def test_awkward_rows_and_empty_tables(spark, frame, awkward):
    benchmark = spark.createDataFrame([(1, "no id")], "item_id long, text string")
    rows = find_contamination(frame(awkward), benchmark).collect()
    assert len(rows) == len(awkward)
    assert [r["text"] for r in rows if r["contaminated"]] == ["no id here"]
    assert find_contamination(frame([]), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(frame(awkward), none).where("n_hit > 0").count() == 0


def test_parts_are_searched_one_after_the_other(spark, frame, prose, monkeypatch):
    """Neither the driver nor a task ever holds more than one part."""
    from innsight.llm import decontaminate

    held, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(
        type(spark.sparkContext),
        "broadcast",
        lambda self, value: held.append(sum(len(t) + len(i) for i, t in value)) or broadcast(self, value),
    )
    items = [(i, f"item {i} {prose(20)} {i}") for i in range(120)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"before {items[i % 120][1]} after {items[i * 7 % 120][1]}" if i % 3 else prose(90)) for i in range(60)]
    docs = frame([*rows, *rows[:5], (99, None)])
    whole = decontaminate.find_contamination(docs, benchmark).collect()
    assert len(held) == 1
    parts = decontaminate.find_contamination(docs, benchmark, shard_bytes=2000).collect()
    assert len(held) > 6 and max(held[1:]) < 4 * 2000 < held[0]
    key = lambda r: repr((r["doc_id"], r["text"]))
    assert sorted(whole, key=key) == sorted(parts, key=key)
