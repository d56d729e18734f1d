import random

from tomewright.llm.components import connected_components


def by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_graphs(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(5000, k) for k in range(5001, 5300)]
    loose = [(rng.randint(1, 200), rng.randint(1, 200)) for _ in range(90)]
    edges = chain + star + loose + [(7, 7), (None, 3), (9, None), *loose[:5]]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == by_hand(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
    assert connected_components(spark.createDataFrame([("x", "x")], "a string, b string")).count() == 0
