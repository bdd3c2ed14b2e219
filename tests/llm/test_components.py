"""Connected components by stars against union and find."""

import random

import pytest

from evidenza.llm.components import connected_components


def brute_components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "circle", "empty"])
def test_components(spark, shape):
    r = random.Random(3)
    edges = {
        "random": [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(None, 3), (4, 4), (5, None)],
        "chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 60)] * 2, "circle": [(i, (i + 1) % 17) for i in range(17)], "empty": [],
    }[shape]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {x["node"]: x["component"] for x in connected_components(df).collect()}
    assert got == brute_components(edges)


def test_components_of_strings(spark):
    df = spark.createDataFrame([("b", "a"), ("é", "b"), ("Z", "a")], "a string, b string")
    assert {x["component"] for x in connected_components(df).collect()} == {"Z"}
