"""Components against a plain union-find, and the rounds that long chains take."""

import random

from sextant.operators.components import connected, rounds


def plain(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_match_a_plain_union_find(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(900 - k, 999) for k in range(30)] + [(201, 200), (200, 201), (300, 300)]
    edges += [(1000 + r.randrange(200), 1000 + r.randrange(200)) for _ in range(150)]
    found = connected(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted(map(tuple, found)) == sorted(plain(edges).items())
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(1000)], "a long, b long").repartition(100, "a")
    tables = list(rounds(chain))
    assert len(tables) <= 12
    assert tables[-1].where("a = 0").count() == 1000
