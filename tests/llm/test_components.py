import random

from shelfrank.llm.components import components


def test_against_brute_force(spark):
    draw = random.Random(0)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 80)] + [(5, 5), (7, 6), (7, 6)]
    head = {x: x for e in edges for x in e}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        head[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_empty(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
