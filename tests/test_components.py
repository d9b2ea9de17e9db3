"""Strong components against mutual reachability."""

import random

import pytest

from tessera.graph.structure import strong_components


def plain_components(edges):
    nodes, out = sorted({n for e in edges for n in e}), {}
    reach = {n: {n} for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                moved = True
    for n in nodes:
        own = {m for m in reach[n] if n in reach[m]}
        if len(own) > 1 or (n, n) in edges:
            out[n] = min(own)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_mutual_reachability(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(i, i + 1) for i in range(100, 140)} | {(n, 200 + (n - 199) % 7) for n in range(200, 207)} | {(300, 300), (204, 110)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long").repartition(3)
    assert {r.node: r.component for r in strong_components(df.union(df)).collect()} == plain_components(edges)


def test_no_components(spark):
    assert strong_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    assert strong_components(spark.createDataFrame([(1, None), (2, 2)], "src long, dst long")).collect() == [(2, 2)]
