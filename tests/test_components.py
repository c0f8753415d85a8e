"""Connected components against union-find."""

import random

from scholion.operators.components import components


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(None, 1), (5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
