"""The stored index: equal to the one made in memory through any changes, and what its plans read."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, stored

WORDS = [f"wort{i}" for i in range(40)] + ["selten", "rare"]
QUERIES = [("a", "wort1 wort2 rare"), ("b", "wort3"), ("c", "selten rare"), ("d", "nowhere"), ("e", ""), ("f", "wort5 wort5 wort6 wort7 wort8")]


def made(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + i, " ".join(rng.choice(WORDS[: rng.choice([3, 10, 42])]) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def answers(df):
    return sorted((r.query_id, r.rank, r.node_id, r.score, tuple(r.matched)) for r in df.collect())


def in_memory(spark, docs, queries, limit):
    terms = index.terms_of(spark.createDataFrame(docs, "id long, text string"))
    return answers(index.bm25(index.postings(terms), index.corpus_stats(terms), queries, limit))


@pytest.mark.parametrize("limit,segment_docs,probe", [(3, 10, 1), (20, 1000, 4), (5, 1, 2)])
def test_searches_through_changes(spark, limit, segment_docs, probe):
    queries = spark.createDataFrame(QUERIES, "query_id string, text string")
    held, docs = stored.temporary_index(spark, buckets=4), {}
    for step in range(4):
        rows = dict(made(step, 80, 50 * step))
        stored.replace_documents(held, spark.createDataFrame(sorted(rows.items()), "id long, text string"), segment_docs=segment_docs)
        docs |= rows
        gone = [i for i in docs if i % 7 == step]
        stored.remove_documents(held, spark.createDataFrame([(i,) for i in [*gone, 10**9]], "id long"))
        for i in gone:
            del docs[i]
        assert answers(stored.search(held, queries, limit, probe)) == in_memory(spark, sorted(docs.items()), queries, limit)
    want = {i: len(t.split()) for i, t in docs.items()}
    assert tuple(stored.stats_of(held).first()) == (len(want), sum(want.values()))
    again = stored.open_index(spark, held.path, buckets=4)
    assert again.generation == held.generation and answers(stored.search(again, queries, limit)) == in_memory(spark, sorted(docs.items()), queries, limit)


def test_odd_documents(spark):
    held = stored.temporary_index(spark, buckets=2)
    queries = spark.createDataFrame([("q", "wort1"), (None, "wort1")], "query_id string, text string")
    assert stored.search(held, queries).collect() == [] and held.generation == 0
    stored.add_documents(held, spark.createDataFrame([(None, "wort1"), (1, None), (2, ""), (3, "wort1"), (3, "wort1"), (4, "x " * 50_000 + "wort1")], "id long, text string"))
    assert [(r.node_id, r["rank"]) for r in stored.search(held, queries).where("query_id = 'q'").orderBy("rank").collect()] == [(3, 1), (4, 2)]
    assert stored.stats_of(held).first().doc_count == 4


def exchange_below_join(plan, column):
    """Whether an exchange stands between the scan that reads a column and the join above it."""
    lines = plan.splitlines()
    depth_of = lambda line: len(line) - len(line.lstrip(" :+-*"))
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and column in line)
    depth = depth_of(lines[at])
    for line in reversed(lines[:at]):
        if depth_of(line) < depth:
            depth = depth_of(line)
            if "Join" in line:
                return False
            if "Exchange" in line:
                return True
    raise AssertionError("no join")


def test_postings_stay_where_they_lie(spark):
    """Also where nothing may be broadcast, blocks are not shuffled; heads are read without postings; no text is read."""
    held = stored.temporary_index(spark, buckets=8)
    stored.add_documents(held, spark.createDataFrame(made(1, 300), "id long, text string"), segment_docs=20)
    queries = spark.createDataFrame(QUERIES, "query_id string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = stored._asked(held, queries)
        segments = stored.bounds(held, asked)
        plan = stored.scores(held, asked, segments)._jdf.queryExecution().executedPlan().toString()
        heads = segments._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    full = next(line for line in plan.splitlines() if "FileScan" in line and "tfs" in line)
    assert "Bucketed: true" in full
    assert not exchange_below_join(plan, "tfs")
    assert not any("tfs" in line for line in heads.splitlines() if "FileScan" in line)


def test_segments_out_of_reach_are_passed_over(spark):
    """A rare word and a common one: segments without the rare one can't reach the best."""
    docs = [(i, "common " * 3 + ("rare " if i % 100 == 0 else "") + f"x{i}") for i in range(1000)]
    held = stored.temporary_index(spark, buckets=4)
    stored.add_documents(held, spark.createDataFrame(docs, "id long, text string"), segment_docs=10)
    queries = spark.createDataFrame([("q", "common rare")], "query_id string, text string")
    told = stored.skipped(held, queries, limit=5, probe=5).first()
    assert told.segments > 80 and told.read <= 12
    assert answers(stored.search(held, queries, 5, 5)) == in_memory(spark, docs, queries, 5)


def test_changes_touch_only_what_changed(spark):
    held = stored.temporary_index(spark, buckets=4)
    stored.add_documents(held, spark.createDataFrame(made(1, 400), "id long, text string"))
    files = lambda: {(f["path"], f["length"], str(f["modificationTime"])) for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(held.path).select("path", "length", "modificationTime").collect()}
    first = files()
    stored.replace_documents(held, spark.createDataFrame([(7, "wort1 neu")], "id long, text string"))
    more = files() - first
    assert first <= files() and sum(n for _, n, _ in more) < 0.6 * sum(n for _, n, _ in first)
    assert held.table("blocks").where(F.shiftright("segment", 32) > 1).count() == 2


def test_repeated_ids_count_once_and_blocks_are_written_where_they_are_made(spark):
    """Of a repeated id the least text counts; postings are sent once, by segment, and not again to be written."""
    docs = spark.createDataFrame([(1, "beta alpha"), (1, "alpha alpha"), (2, "alpha"), (3, None), (None, "alpha")], "id long, text string")
    held = stored.temporary_index(spark, buckets=2)
    sent, insert = [], stored._insert
    try:
        stored._insert = lambda index, kind, rows, *by: sent.append((kind, rows._jdf.queryExecution().executedPlan().toString(), by)) or insert(index, kind, rows, *by)
        stored.add_documents(held, docs)
    finally:
        stored._insert = insert
    assert {r.term: r.n for r in held.table("blocks").groupBy("term").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()} == {"alpha": 2}
    assert {(r.node_id, r.doc_len) for r in held.table("documents").collect()} == {(1, 2), (2, 1), (3, 0)}
    plan = next(p for kind, p, by in sent if kind == "blocks" and not by)
    assert plan.count("Exchange hashpartitioning") == 1
