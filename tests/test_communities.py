"""Communities against a plain Louvain, and what must hold of any: connected, settled."""

import random

import pytest

from tessera.graph import structure
from tessera.graph.structure import communities, modularity


def plain_modularity(edges, label):
    m, inside, volume = 2.0 * sum(edges.values()), 0.0, {}
    for (a, b), w in edges.items():
        inside += 2 * w * (label[a] == label[b])
        for n in (a, b):
            volume[label[n]] = volume.get(label[n], 0.0) + w
    return inside / m - sum(v * v for v in volume.values()) / (m * m)


def plain_louvain(edges):
    """One node at a time, in order, level by level."""
    near, label = {}, {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    member, graph = {n: n for n in near}, near
    total = 2.0 * sum(edges.values())
    while True:
        label = {n: n for n in graph}
        degree = {n: sum(ws.values()) for n, ws in graph.items()}
        volume, any_move, moved = dict(degree), False, True
        while moved:
            moved = False
            for n in sorted(graph):
                volume[label[n]] -= degree[n]
                to = {label[n]: 0.0}
                for o, w in graph[n].items():
                    if o != n:
                        to[label[o]] = to.get(label[o], 0.0) + w
                best = max(sorted(to), key=lambda c: to[c] - degree[n] * volume[c] / total)
                gain = lambda c: to[c] - degree[n] * volume[c] / total
                if gain(best) > gain(label[n]) + 1e-9:
                    label[n], moved, any_move = best, True, True
                volume[label[n]] += degree[n]
        if not any_move:
            return member
        member = {n: label[c] for n, c in member.items()}
        above: dict = {}
        for n, ws in graph.items():
            for o, w in ws.items():
                above.setdefault(label[n], {})[label[o]] = above.get(label[n], {}).get(label[o], 0.0) + w
        graph = above


def connected(edges, label):
    root = {n: n for n in label}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if label[a] == label[b]:
            root[find(a)] = find(b)
    return len({find(n) for n in label}) == len(set(label.values()))


@pytest.mark.parametrize("groups,within,between", [(3, 0.35, 0.05)])
def test_settled_connected_and_as_good_as_one_at_a_time(spark, groups, within, between):
    rng, edges = random.Random(groups), {}
    for a in range(45):
        for b in range(a):
            if rng.random() < (within if a % groups == b % groups else between):
                edges[(b, a)] = rng.choice([1.0, 2.0])
    rows = [(a, b, w) if rng.random() < 0.5 else (b, a, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame([*rows, (3, 3, 9.0), (None, 3, 1.0)], "src long, dst long, weight double").repartition(3)
    found = communities(df)
    label = {r.node: r.community for r in found.collect()}
    assert set(label) == {n for e in edges for n in e} and all(c == min(n for n in label if label[n] == c) for c in label.values())
    assert connected(edges, label)
    assert plain_modularity(edges, label) >= plain_modularity(edges, plain_louvain(edges)) - 0.01
    assert abs(modularity(df.where("src IS NOT NULL"), found) - plain_modularity(edges, label)) < 1e-9
    # nothing gains: no single node's move, and no merger of two communities
    best = plain_modularity(edges, label)
    for c in set(label.values()):
        for d in set(label.values()):
            assert plain_modularity(edges, {n: c if x == d else x for n, x in label.items()}) <= best + 1e-9


def test_long_path_settles(spark):
    """A path offers every node the same gain on both sides: halves that move at once cross."""
    edges = {(i, i + 1): 1.0 for i in range(40)}
    label = {r.node: r.community for r in communities(spark.createDataFrame([(a, b) for a, b in edges], "src long, dst long")).collect()}
    assert connected(edges, label) and plain_modularity(edges, label) >= plain_modularity(edges, plain_louvain(edges)) - 0.02
    assert communities(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_rounds_send_no_table_through_the_driver(spark):
    """Rounds are many: what each broadcasts adds up at the driver."""
    graph = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, w double")
    label = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (2, 2, 1.0)], "node long, community long, degree double")
    plan = structure._offers(graph, label, 4.0, 1e-9)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
