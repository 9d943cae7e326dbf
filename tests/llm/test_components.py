import random

import pytest

from quirelake.llm.common import Scratch
from quirelake.llm.components import components


@pytest.mark.parametrize(("n", "m", "seed"), [(30, 20, 1), (40, 60, 2), (12, 0, 3)])
def test_components(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += [(100 + i, 101 + i) for i in range(15)] + [(200, 200 + i) for i in range(9)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
