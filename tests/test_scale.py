"""Ranks, spans and names against plain versions, and what they must not do with hot files and names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import code, memory, ranking, spans, surface
from tessera.session import keep

# --- ranks -------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 9])
def test_ranks_are_places_in_the_order(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 2, 3]), rng.choice(["a", "b"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, n int, rank string").repartition(parts)
    got = ranking.ranked(df, [F.desc("n"), F.asc("rank"), F.asc("id")], "place")
    assert got.columns == ["id", "n", "rank", "place"]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r.place)] == want and sorted(r.place for r in got.collect()) == list(range(1, 501))
    assert ranking.ranked(df.limit(0), [F.asc("id")]).collect() == []


def test_no_window_is_without_a_partition(spark):
    df = spark.range(100).withColumn("n", F.col("id") % 7)
    plan = ranking.ranked(df, [F.asc("n"), F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


# --- spans -------------------------------------------------------------------------------------


def plain_enclosing(points, symbols, reach):
    out = set()
    for file, line in points:
        best = [(b - a, i) for f, i, a, b in symbols if f == file and a is not None and b is not None and a <= line <= b]
        below = [(a - line, i) for f, i, a, b in symbols if f == file and a is not None and b is not None and 0 < a - line <= reach]
        out.add((file, line, min(best)[1] if best else min(below)[1] if below else None))
    return out


@pytest.mark.parametrize("reach,block", [(0, 4096), (3, 4096), (3, 8), (20, 5)])
def test_innermost_spans_equal_all_pairs(spark, reach, block):
    rng = random.Random(reach * block)
    files = ["a", "b", "c", "d", None]
    symbols = [(rng.choice(files), f"s{i}", a, a + rng.choice([-2, 0, 1, 5, 40])) for i, a in enumerate(rng.randint(-3, 120) for _ in range(150))] + [("a", "n1", None, 5), ("a", "n2", 3, None), ("b", "dup", 3, 9), ("b", "dap", 3, 9)]
    points = [(rng.choice(files[:4]), rng.randint(-5, 140)) for _ in range(300)]
    s = spark.createDataFrame(symbols, "file_path string, id string, start_line int, end_line int").repartition(3)
    p = spark.createDataFrame(points, "file_path string, line int").distinct()
    found = {(r.file_path, r.line, r.handler) for r in spans.stab(p, s, reach, block).collect()}
    assert found == {w for w in plain_enclosing(points, symbols, reach) if w[2] is not None}
    every = surface.enclosing(spark.createDataFrame(points + [(None, 3), ("a", None)], "file_path string, line int"), s, reach)
    assert {(r.file_path, r.line, r.handler) for r in every.collect()} == plain_enclosing(points, symbols, reach) | {(None, 3, None), ("a", None, None)}
    assert every.count() == len(points) + 2


def test_a_hot_file_is_swept_not_paired(spark):
    """100,000 lines and 10,000 symbols of one file: events, not pairs, reach the tasks."""
    symbols = spark.range(10_000).select(F.lit("hot").alias("file_path"), F.concat(F.lit("s"), "id").alias("id"), (F.col("id") * 10 + 1).cast("int").alias("start_line"), (F.col("id") * 10 + 8).cast("int").alias("end_line"))
    symbols = symbols.union(spark.range(20).select(F.lit("hot"), F.concat(F.lit("outer"), "id"), (F.col("id") * 5000).cast("int"), (F.col("id") * 5000 + 4999).cast("int")))
    points = spark.range(100_000).select(F.lit("hot").alias("file_path"), F.col("id").cast("int").alias("line"))
    got = spans.stab(points, symbols)
    counts = got.groupBy(F.col("handler").startswith("outer").alias("outer")).count().collect()
    assert {r.outer: r["count"] for r in counts} == {False: 80_000, True: 20_000}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [4, 256])
def test_overlaps_equal_all_pairs(spark, block):
    rng = random.Random(block)
    a = [(rng.choice("xy"), i, s, s + rng.choice([-1, 0, 3, 30])) for i, s in enumerate(rng.randint(1, 100) for _ in range(60))]
    b = [(rng.choice("xy"), 1000 + i, s, s + rng.choice([0, 9, 60])) for i, s in enumerate(rng.randint(1, 100) for _ in range(60))]
    left, right = spark.createDataFrame(a, "k string, i long, a int, b int"), spark.createDataFrame(b, "k string, j long, c int, d int")
    got = spans.overlapping(left, right, (F.col("a"), F.col("b")), (F.col("c"), F.col("d")), "k", block)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for k, i, s, e in a for m, j, u, v in b if k == m and s <= e and u <= v and s <= v and u <= e)


# --- names -------------------------------------------------------------------------------------


def plain_choose(site, symbols, imports, visible):
    call, file, name, use, receiver, of_type = site
    named = [s for s in symbols if s[1] == name]
    kinds = {"new": {"class", "struct"}, "call": {"function", "method"}}[use]
    fit = [s for s in named if s[3] in kinds] or named
    owner = lambda s: s[0].split(":")[-1].split(".")[-2] if "." in s[0].split(":")[-1] else ""
    rules = [("type", lambda s: owner(s) == of_type), ("file", lambda s: s[2] == file), ("receiver", lambda s: owner(s) == receiver), ("import", lambda s: (file, s[2]) in imports), ("import", lambda s: (file, owner(s)) in visible), ("unique", lambda s: True)]
    for label, test in rules:
        hit = [s for s in fit if test(s)]
        if len(hit) == 1:
            return call, hit[0][0], label, None
    return call, None, None, "ambiguous" if named else "external"


def test_choices_equal_a_look_at_every_candidate(spark):
    rng = random.Random(4)
    files, owners, names = ["f1.ts", "f2.ts", "f3.ts"], ["A", "B", "C"], ["go", "run", "make", "only"]
    symbols = set()
    for i in range(40):
        file, name = rng.choice(files), rng.choice(names[:3])
        tail = f"{rng.choice(owners)}.{name}" if rng.random() < 0.7 else f"{name}"
        symbols.add((f"Symbol:{file}:{tail}", name, file, rng.choice(["function", "method", "class", "variable"])))
    symbols = [s for n, s in enumerate(sorted(symbols)) if s[0] not in {t[0] for t in sorted(symbols)[:n]}] + [("Symbol:f3.ts:only", "only", "f3.ts", "function")]
    imports, visible = {("f1.ts", "f2.ts"), ("f2.ts", "f1.ts"), ("f2.ts", "f3.ts")}, {("f1.ts", "B"), ("f3.ts", "A"), ("f3.ts", "C")}
    sites = [(f"c{i}", rng.choice(files), rng.choice([*names, "nothing"]), rng.choice(["call", "new"]), rng.choice([None, *owners]), rng.choice([None, None, *owners])) for i in range(400)]
    got = code.choose(spark.createDataFrame(sites, "call_id string, file_path string, name string, kind string, receiver string, receiver_type string"), spark.createDataFrame(symbols, "id string, name string, file_path string, kind string"), spark.createDataFrame([*imports, ("f1.ts", "f2.ts")], "src string, dst string"), spark.createDataFrame([*visible], "file_path string, container string"))
    want = [plain_choose(s, symbols, imports, visible) for s in sites]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len({w[2] for w in want}) == 6


def test_a_hot_name_makes_no_pairs(spark):
    """A name with 10,000 declarations and 100,000 sites: every join's rows are sites or declarations."""
    symbols = spark.range(10_000).select(F.concat(F.lit("Symbol:f"), "id", F.lit(".ts:C"), "id", F.lit(".go")).alias("id"), F.lit("go").alias("name"), F.concat(F.lit("f"), "id", F.lit(".ts")).alias("file_path"), F.lit("method").alias("kind"))
    sites = spark.range(100_000).select(F.concat(F.lit("c"), "id").alias("call_id"), F.concat(F.lit("f"), F.col("id") % 20_000, F.lit(".ts")).alias("file_path"), F.lit("go").alias("name"), F.lit("call").alias("kind"), F.lit(None).cast("string").alias("receiver"), F.when(F.col("id") % 2 == 0, F.lit("C7")).alias("receiver_type"))
    got = code.choose(keep(sites, "sites"), keep(symbols, "symbols"), spark.createDataFrame([], "src string, dst string"))  # kept, as literals would be folded out of the join's keys
    assert {(r.confidence, r.reason): r["count"] for r in got.groupBy("confidence", "reason").count().collect()} == {("type", None): 50_000, ("file", None): 25_000, (None, "ambiguous"): 25_000}
    text = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoop", text)


# --- alike titles ------------------------------------------------------------------------------


def test_equal_titles_are_one_class(spark):
    """100,000 equal titles and a few alike: a link for each two classes, from which the pairs follow."""
    rows = spark.range(100_000).select("id", F.lit("fix the login page").alias("title")).union(spark.range(100_000, 100_003).select("id", F.lit("fix the login form page"))).union(spark.range(200_000, 200_001).select("id", F.lit("unrelated words entirely")))
    notes = rows.withColumn("layer", F.lit("semantic")).withColumn("superseded_at", F.lit(None).cast("long"))
    edges = spark.createDataFrame([(5, 3, "SUPERSEDES"), (100_001, 7, "CONTRADICTS"), (200_000, 1, "CONTRADICTS"), (1, 2, "RESOLVES")], "src long, dst long, type string")
    members, links = memory.conflict_classes(notes, edges)
    assert sorted((r.a, r.b, r.pairs, r.explained) for r in links.collect()) == [(0, 0, 100_000 * 99_999 // 2, 1), (0, 100_000, 300_000, 1), (100_000, 100_000, 3, 0)]
    assert {r.rep: r["count"] for r in members.groupBy("rep").count().collect()} == {0: 100_000, 100_000: 3, 200_000: 1}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_alike_pairs_equal_all_pairs(spark, threshold):
    rng = random.Random(9)
    sets = [(i, rng.sample("abcdefgh", rng.randint(1, 5))) for i in range(80)]
    got = memory.similar_pairs(spark.createDataFrame(sets, "id long, terms array<string>"), threshold)
    want = [(i, j, round(len(set(s) & set(t)) / len(set(s) | set(t)), 6)) for i, s in sets for j, t in sets if i < j and len(set(s) & set(t)) >= threshold * len(set(s) | set(t))]
    assert sorted((r.a, r.b, r.similarity) for r in got.collect()) == want


# --- what must not grow --------------------------------------------------------------------------


def test_a_span_of_any_length_is_a_few_rows(spark):
    rows = [("f", "all", 0, 10**13), ("f", "most", 5, 10**12), ("f", "short", 100, 120), ("g", "late", 10**12, 10**12 + 3)]
    s = spark.createDataFrame(rows, "file_path string, id string, start_line long, end_line long")
    p = spark.createDataFrame([("f", 3), ("f", 7), ("f", 110), ("f", 10**12 + 1), ("g", 10**12 + 4), ("g", 10**12 - 2)], "file_path string, line long")
    assert {(r.line, r.handler) for r in spans.stab(p, s, 2).collect()} == {(3, "all"), (7, "most"), (110, "short"), (10**12 + 1, "all"), (10**12 - 2, "late")}


def test_sources_that_reach_the_same_nodes_share_words(spark):
    from tessera.graph.frontier import search_packed

    edges = spark.createDataFrame([(f"s{i}", f"hub{i % 8}") for i in range(512)] + [(f"hub{k}", f"end{k}") for k in range(8)], "src string, dst string")
    seeds = spark.createDataFrame([(f"s{i}", f"s{i}") for i in range(512)], "source string, node string")
    found, _ = search_packed(edges, seeds, 2)
    assert found.where("node LIKE 'hub%' OR node LIKE 'end%'").select("node", "word").distinct().count() <= 48


def test_neighbours_beyond_a_full_answer_are_not_searched(spark, monkeypatch):
    edges = spark.createDataFrame([("a", f"b{i}") for i in range(9)] + [(f"b{i}", f"c{j}") for i in range(9) for j in range(9)], "src string, dst string").withColumns({"type": F.lit("T"), "weight": F.lit(0.5)})
    kept = []
    monkeypatch.setattr(memory, "keep", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    got = memory.neighbors(edges, spark.createDataFrame([("a", "a")], "source string, node string"), depth=4, limit=9).collect()
    assert [r.node for r in sorted(got, key=lambda r: r["rank"])] == [f"b{i}" for i in range(9)] and all(len(r.via) == 1 and r.via[0]["from"] == "a" for r in got)
    assert sum(k.count() for k in kept) == 10


def test_hashed_embeddings_are_doubles_to_the_last_and_say_where_all_cancels(spark):
    from tessera.functions.embed import hash_embedding

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id IN (8985, 9418)")
    got = {r.id: r.embedding for r in hash_embedding(docs, 64, "doc_id", kind="double", cancelled=float("nan")).collect()}
    assert [i for i, v in enumerate(got[8985]) if v != 0] == [38] and got[8985][38] is None
    assert [round(got[9418][i], 4) for i in (43, 25, 15)] == [0.1404, 0.1404, -0.1404]


def test_names_asked_alike_are_resolved_once(spark, monkeypatch):
    seen, plain = [], code._resolved_once
    monkeypatch.setattr(code, "_resolved_once", lambda asked, *rest: seen.append(asked.count()) or plain(asked, *rest))
    s = spark.createDataFrame([(f"Symbol:f{i}.ts:go", "go", f"f{i}.ts") for i in range(20)], "id string, name string, file_path string")
    none = spark.createDataFrame([], "src string, dst string")
    asked = spark.createDataFrame([(f"q{i}", "go", None, None) for i in range(30)] + [("one", "go", None, "f3.ts"), ("no", "g", None, None)], "query_id string, name string, uid string, file string")
    got = code.resolve_targets(asked, s, none, none).collect()
    assert seen == [3] and len(got) == 30 * 20 + 1 + 5
    assert {(r.status, r.id) for r in got if r.query_id == "one"} == {("ok", "Symbol:f3.ts:go")} and {r.status for r in got if r.query_id == "no"} == {"not_found"}
    assert all(sorted(r["rank"] for r in got if r.query_id == f"q{i}") == list(range(1, 21)) for i in (0, 29))


def test_a_question_goes_to_the_declarations_not_they_to_it(spark, sf):
    from tessera.plans.catalogue import QUERIES, load_all

    load_all()
    plan = QUERIES["code_query"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin [key" in line]
    assert joins and all("BuildRight" in line for line in joins)


# --- namespaces --------------------------------------------------------------------------------


def test_types_of_a_namespace_are_not_spelled_out_for_each_file(spark):
    from tessera.plans.ingest import read_relations, visible_containers
    from tessera.sources.extract import symbols_of

    files = spark.createDataFrame([(f"m/c{k}.go", f"package p\ntype C{k} struct {{\n}}\nfunc run{k}(n int) int {{\n  return run{k // 2}(n)\n}}\n") for k in range(40)], "path string, text string")
    visible, members = visible_containers(read_relations(files)["file"], symbols_of(files))
    assert (visible.count(), members.count()) == (40, 40)


def test_files_are_parsed_over_all_cores(spark):
    from tessera.sources.extract import symbols_of

    files = spark.createDataFrame([(f"c{k}.go", f"package p\nfunc run{k}(n int) int {{\n  return 1\n}}\n") for k in range(200)], "path string, text string").coalesce(1)
    assert symbols_of(keep(files, "files")).rdd.getNumPartitions() > 1


def test_a_name_seen_through_namespaces_is_the_one_seen_type_by_type(spark):
    rng = random.Random(5)
    symbols = sorted({(f"Symbol:f{rng.randrange(6)}.cs:T{t}.n{n}", f"n{n}", f"f{rng.randrange(6)}.cs", rng.choice(["method", "class"])) for t in range(8) for n in range(6) if rng.random() < 0.4})
    opened = sorted({(f"f{f}.cs", f"s{rng.randrange(4)}") for f in range(6) for _ in range(2)})
    members = sorted({(f"s{rng.randrange(4)}", f"T{t}") for t in range(8) for _ in range(2)})
    visible = sorted({(f, t) for f, s in opened for u, t in members if u == s})
    sites = [(str(i), f"f{rng.randrange(6)}.cs", f"n{rng.randrange(7)}", rng.choice(["call", "new"]), None, None) for i in range(120)]
    make = spark.createDataFrame
    fixed = (make(sites, "call_id string, file_path string, name string, kind string, receiver string, receiver_type string"), make(symbols, "id string, name string, file_path string, kind string"), make([], "src string, dst string"))
    through = code.choose(*fixed, make(opened, "file_path string, container string"), make(members, "container string, owner string"))
    plain = code.choose(*fixed, make(visible, "file_path string, container string"))
    got, want = sorted(map(tuple, through.collect()), key=repr), sorted(map(tuple, plain.collect()), key=repr)
    assert got == want and {c for _, _, c, _ in got} >= {"import", "file"}


# --- what a worker holds -----------------------------------------------------------------------


def test_texts_are_counted_in_portions_whatever_the_batch(spark, monkeypatch):
    import pandas as pd

    from tessera.functions import text

    monkeypatch.setattr(text, "PORTION", 50)
    batch = pd.Series(["a" * 20, None, "", "b" * 70, "c" * 10, "d" * 10])
    parts = list(text.portions(batch))
    assert [v for p in parts for v in p] == list(batch) and max(sum(len(v or "") for v in p[:-1]) for p in parts) < 50 and len(parts) > 1
    assert list(text.portions(pd.Series([], dtype=object))) == [[]]
    docs = spark.createDataFrame([(i, "word " * (i % 7) + f"own{i}") for i in range(500)], "id long, text string")
    got = {r.id: dict(zip(r.t.terms, r.t.tfs)) for r in docs.select("id", text.term_counts(F.col("text")).alias("t")).collect()}
    assert got == {i: {k: n for k, n in (("word", i % 7), (f"own{i}", 1)) if n} for i in range(500)}


def test_products_in_slices_are_those_of_all(spark, monkeypatch):
    """Ties go to the smaller id across slices, and a task sends its best once, not once a slice."""
    import numpy as np

    from tessera.operators import retrieval

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)]) for i in rng.permutation(300)]
    vectors = spark.createDataFrame(rows, "node_id long, embedding array<float>").coalesce(1)
    matrix = retrieval._unit(np.array([v for _, v in rows[:6]]))
    monkeypatch.setattr(retrieval, "AT_ONCE", 60)  # ten vectors at a time
    monkeypatch.setattr(retrieval, "spread", lambda df: df)
    got = sorted(map(tuple, retrieval._products(vectors, list("abcdef"), matrix, 5, "query_id string, node_id long, similarity double").collect()))
    s = np.round(retrieval._unit(np.array([v for _, v in rows])) @ matrix.T, 5)
    want = sorted((q, rows[i][0], s[i, j]) for j, q in enumerate("abcdef") for i in sorted(range(300), key=lambda i: (-s[i, j], rows[i][0]))[:5])
    assert got == want
