import random

import pytest

from trailweave.llm.components import connected_components


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in list(root)}


def graphs():
    rng = random.Random(1)
    order = list(range(70))
    rng.shuffle(order)
    yield [(1, 1), (None, 2)]
    yield list(zip(order, order[1:]))
    yield [(i, i + 1) for i in range(90)]
    yield [(500, i) for i in range(200)] + [(0, 999), (7, 7)]
    yield [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(3, 4)] * 5


@pytest.mark.parametrize("pairs", list(graphs()))
def test_equals_union_find(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, b int")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == brute([p for p in pairs if None not in p])
