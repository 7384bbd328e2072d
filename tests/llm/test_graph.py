import random

from webdiag.llm.graph import components


def test_chains_stars_and_loops(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(5, i) for i in range(6, 300)] + [(7777, 7777)]
    edges += [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(300)]
    rnd.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
