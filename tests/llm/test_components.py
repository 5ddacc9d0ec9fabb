import random

from innsight.llm.components import connected_components


def test_chains_stars_and_copies(spark):
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)]
    links += [(draw.randrange(1000, 1060), draw.randrange(1000, 1060)) for _ in range(40)]
    links += links[:5] + [(3, 3), (None, 4), (5, None), (130, 205)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(map(tuple, connected_components(df, "a", "b").collect()))
    assert got == {x: find(x) for x in root}


def test_no_links(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert connected_components(df, "a", "b").count() == 0
