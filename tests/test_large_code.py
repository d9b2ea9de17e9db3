"""Code tables grow with the code, whatever the planner makes of their files: nothing of them goes through the driver."""

import random

import pytest

from tessera.graph import frontier
from tessera.operators import memory, pairs
from tessera.plans import ingest, q_code, q_notes
from tessera.plans.catalogue import code_graph
from tessera.session import keep


def broadcasts(df):
    """Joins the planner means to answer by broadcast, before it has run anything."""
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_the_code_graph_is_joined_by_sorting(spark, sf):
    g = code_graph(spark, sf)
    assert {name: broadcasts(df) for name, df in g.items()} == dict.fromkeys(g, 0)


def test_targets_are_resolved_without_broadcasts(spark, sf, monkeypatch):
    kept, real = [], q_code.code.keep
    monkeypatch.setattr(q_code.code, "keep", lambda df, name: kept.append(df) or real(df, name))
    df = q_code.resolve_targets(spark, sf)
    assert len(kept) == 2 and [broadcasts(d) for d in [*kept, df]] == [0, 0, 0]


@pytest.mark.parametrize("most", [1, 3, 100])
def test_pairs_of_lots_are_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(pairs, "IN_A_LOT", most)
    rng = random.Random(most)
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None]), f"l{i // 2}") for i in range(40)]
    right = [(rng.choice(["a", "b", "d", None]), rng.choice([1, 2, None]), rng.choice([None, i]), None) for i in range(30)]
    got = pairs.spelled_out(spark.createDataFrame(left, "k string, j int, x string"), spark.createDataFrame(right, "k string, j int, y int, z string"), ["k", "j"])
    want = [(k, j, x, y, z) for k, j, x in left for m, n, y, z in right if k == m and j == n and k and j]
    assert got.columns == ["k", "j", "x", "y", "z"] and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 10


def test_links_of_notes_need_no_broadcast_and_few_copies(spark, sf):
    """5,000 notes and 5,000 declarations of one line are one block: neither is copied to be dealt out."""
    assert broadcasts(q_notes.span_links_of_notes(spark, sf)) == 0
    assert min(ingest.AT_A_PLACE, ingest.NOTES_AT_A_PLACE) >= 5_000


def plain(g):
    """The code graph's tables as they would come from small files: without hints, and known to be small."""
    return {name: keep(df, name) for name, df in g.items()}


def test_traces_broadcast_no_code(spark, sf, monkeypatch):
    g, plans, real = plain(code_graph(spark, sf)), [], frontier.keep
    monkeypatch.setattr(frontier, "keep", lambda df, name: plans.append((name, df)) or real(df, name))
    monkeypatch.setattr(frontier, "FEW", 10)
    a = g["symbol"].where("kind = 'class'").selectExpr("id source", "p div 8 q")
    pairs = a.join(g["symbol"].selectExpr("p q", "id target").hint("merge"), "q").select("source", "target")
    out = q_code.code.trace(pairs, g["symbol"], g["calls"], max_depth=1)
    assert [n for n, df in [*plans, ("out", out)] if broadcasts(df)] == []


def test_clusters_broadcast_no_code(spark, sf, monkeypatch):
    """What communities are made from, and what is joined to them."""
    g, asked = plain(code_graph(spark, sf)), []
    monkeypatch.setattr(q_code.code, "communities", lambda df: asked.append(df) or g["symbol"].selectExpr("id node", "file_path community"))
    monkeypatch.setattr(q_code.code, "keep", lambda df, name: asked.append(df) or keep(df, name))
    q_code.code.code_clusters(g["symbol"], g["calls"], g["inherits"])
    assert len(asked) == 2 and [broadcasts(df) for df in asked] == [0, 0]


def test_similar_pairs_are_spelled_out_without_lists(spark):
    """Rows meet rows: no list of a class's members is carried to each of them and taken apart again."""
    sets = spark.range(300).selectExpr("id", "array('alike', 'words', cast(id % 3 as string)) terms")
    df = memory.similar_pairs(sets, 0.5)
    assert "collect_list(id" not in df._jdf.queryExecution().sparkPlan().toString() and df.count() == 300 * 299 // 2
