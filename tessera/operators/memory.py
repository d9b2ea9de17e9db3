"""Operators on the memory graph: neighbours, clusters, conflicts, constraints, changes, pruning, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import token_set
from tessera.graph.structure import communities
from tessera.model import DAY_MS, EDGE_TYPES, LAYER_WEIGHT, TOKENIZER_VERSION
from tessera.operators.index import top
from tessera.operators.pairs import spelled_out
from tessera.operators.retrieval import live
from tessera.session import keep

MAX_HOPS = 4


def directed(edges: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """src, dst, type, weight, direction as walked."""
    rows = edges.where(F.col("type").isin(types)) if types else edges
    out = rows.select("src", "dst", "type", "weight", F.lit("out").alias("direction"))
    back = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight", F.lit("in").alias("direction"))
    return {"out": out, "in": back}.get(direction, out.unionByName(back))


def neighbors(edges: DataFrame, starts: DataFrame, *, depth: int = 2, direction: str = "both", types: list[str] | None = None, limit: int = 50) -> DataFrame:
    """source, node, hops, score, via, rank: what lies within ``depth`` (at most 4) hops.

    score is the best arriving edge's weight halved per hop beyond the first; via lists all edges that arrive from the level before.
    """
    walk = directed(edges, direction, types)
    level = keep(starts.select("source", "node").distinct().withColumn("hops", F.lit(0)), "hops")
    seen, rows, levels = level.select("source", "node"), None, level.select("source", "node", "hops")
    for hop in range(1, min(depth, MAX_HOPS) + 1):
        # nearer nodes come first, so a source that has ``limit`` of them is answered
        going = level if rows is None else level.join(rows.groupBy("source").agg(F.count("*").alias("have")).where(F.col("have") >= limit), "source", "left_anti")
        arrived = going.join(walk, going["node"] == walk["src"]).groupBy("source", F.col("dst").alias("next")).agg(F.round(F.max("weight") * 0.5 ** (hop - 1), 6).alias("score"))
        level = keep(arrived.join(seen.withColumnRenamed("node", "next"), ["source", "next"], "left_anti").select("source", F.col("next").alias("node"), F.lit(hop).alias("hops"), "score"), "hops")
        if level.isEmpty() and rows is not None:
            break
        rows = level if rows is None else rows.unionByName(level)
        seen = seen.unionByName(level.select("source", "node"))
        levels = levels.unionByName(level.select("source", "node", "hops"))
    # what arrives is gathered for the answer only
    told = top(rows, "source", limit, F.asc("hops"), F.desc("score"), F.asc("node"))
    ways = told.select("source", "node", F.col("hops") - 1).toDF("source", "dst", "before").join(walk, "dst").join(levels.toDF("source", "src", "before"), ["source", "src", "before"], "left_semi")
    via = ways.groupBy("source", F.col("dst").alias("node")).agg(F.array_sort(F.collect_set(F.struct("type", "direction", F.col("src").alias("from")))).alias("via"))
    return told.join(via, ["source", "node"]).select("source", "node", "hops", "score", "via", "rank")


def conflicts(memory: DataFrame, edges: DataFrame, threshold: float = 0.6) -> DataFrame:
    """a, b, kind, similarity: declared contradictions, then live semantic pairs whose titles are suspiciously alike.

    This spells out every pair; where many titles are equal, ``conflict_classes`` says the same in rows by title.
    """
    declared = edges.where("type = 'CONTRADICTS'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    suspected = similar_pairs(_title_terms(memory), threshold).join(_explained(edges), ["a", "b"], "left_anti")
    return declared.select("a", "b", F.lit("declared").alias("kind"), F.lit(1.0).alias("similarity")).unionByName(suspected.select("a", "b", F.lit("suspected").alias("kind"), "similarity"))


def _title_terms(memory: DataFrame) -> DataFrame:
    return live(memory, ["semantic"]).select("id", token_set(F.col("title")).alias("terms")).where(F.size("terms") > 0)


def _explained(edges: DataFrame) -> DataFrame:
    return edges.where("type IN ('CONTRADICTS', 'SUPERSEDES')").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()


def conflict_classes(memory: DataFrame, edges: DataFrame, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep, size) and suspected links (a, b, similarity, pairs, explained) between classes of titles with the same terms.

    A class is named by its smallest id; a link from a class to itself stands for the pairs inside. ``pairs`` is how many pairs of rows a link stands for, ``explained`` how
    many of them an edge already links. So 100,000 equal titles are one link, and the pairs are those of its members less the explained.
    """
    members, links = similar_classes(_title_terms(memory), threshold)
    inside = members.where("size > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"), (F.col("size") * (F.col("size") - 1) / 2).cast("long").alias("pairs")).distinct()
    sizes = members.select("rep", "size").distinct()
    between = links.join(sizes.select(F.col("rep").alias("a"), F.col("size").alias("n")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("size").alias("m")), "b").select("a", "b", "similarity", (F.col("n") * F.col("m")).alias("pairs"))
    ends = _explained(edges).join(members.select(F.col("id").alias("a"), F.col("rep").alias("x")), "a").join(members.select(F.col("id").alias("b"), F.col("rep").alias("y")), "b")
    known = ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("explained"))
    return members, inside.unionByName(between).join(known, ["a", "b"], "left").withColumn("explained", F.coalesce("explained", F.lit(0)))


def similar_classes(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep, size) of classes of equal sets, and a, b, similarity of the classes whose Jaccard similarity is at least ``threshold``.

    Sets are compared once for each class. Two that reach the threshold share one of the first n - ceil(threshold * n) + 1 of each, rarest first, so common
    words join nothing.
    """
    keyed = keep(sets.select("id", F.array_sort("terms").alias("terms"), F.sha2(F.array_join(F.array_sort("terms"), "\n"), 256).alias("key")), "sets")
    classes = keep(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.min("terms").alias("terms")), "classes")
    members = keyed.select("id", "key").join(classes.select("key", "rep", "size"), "key").select("id", "rep", "size")
    df = classes.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ordered = classes.select("rep", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(df, "term").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("order"))
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    prefix = ordered.select("rep", "n", F.explode(F.slice("order", F.lit(1), length)).alias("p")).select("rep", "n", F.col("p.term").alias("term"))
    x, y = prefix.alias("x"), prefix.alias("y")
    near = x.join(y, (F.col("x.term") == F.col("y.term")) & (F.col("x.rep") < F.col("y.rep")) & (F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n") - 1e-9))
    pairs = near.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    whole = pairs.join(classes.select(F.col("rep").alias("a"), F.col("terms").alias("s")), "a").join(classes.select(F.col("rep").alias("b"), F.col("terms").alias("t")), "b")
    value = F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))
    return members, whole.where(value >= threshold).select("a", "b", F.round(value, 6).alias("similarity"))


#: Members of a class that are dealt out as one lot; two lots are spelled out together.
IN_A_LIST = 1024


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of all pairs of id, terms whose Jaccard similarity is at least ``threshold``: the classes' links spelled out.

    Every link, and every class of several, is a key that its members share, and ``spelled_out`` deals the pairs out in blocks of lots of ``IN_A_LIST``: a large class is many tasks; its pairs are
    never in one.
    """
    members, links = similar_classes(sets, threshold)
    inside = members.where("size > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    every = keep(links.unionByName(inside), "links")
    ids = members.select("rep", "id")
    left = every.join(ids.toDF("a", "x").hint("merge"), "a").select("a", "b", "similarity", "x")
    right = every.join(ids.toDF("b", "y").hint("merge"), "b").select("a", "b", "y")
    # of a class each pair is met from both sides, and the smaller id comes first
    pairs = spelled_out(left, right, ["a", "b"], IN_A_LIST, IN_A_LIST).where("a <> b OR x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def constraints(memory: DataFrame, limit: int = 10) -> DataFrame:
    """Live semantic rows by importance, then the most recent."""
    return live(memory, ["semantic"]).orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(limit)


def orphans(memory: DataFrame, *links: DataFrame) -> DataFrame:
    """Live reasoning rows that no link (src, dst) touches."""
    return without_links(live(memory).where("layer <> 'artifact'"), *links)


def without_links(rows: DataFrame, *links: DataFrame) -> DataFrame:
    for link in links:
        rows = rows.join(link.select(F.col("src").alias("id")).union(link.select("dst")).distinct(), "id", "left_anti")
    return rows


def prune_candidates(memory: DataFrame, now_ms: Column, *links: DataFrame, older_than_days: int = 90, layer: str | None = "episodic", max_weight: int = 3) -> DataFrame:
    """Rows of a layer, or of layers that weigh at most ``max_weight``, older than the cutoff and without links; cheapest first."""
    if older_than_days <= 0:
        raise ValueError("the cutoff must be above 0 days")
    layers = [layer] if layer else [name for name, weight in LAYER_WEIGHT.items() if weight <= max_weight]
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in LAYER_WEIGHT.items() for x in kv]), F.col("layer"))
    old = memory.where(F.col("layer").isin([x for x in layers if x != "semantic"]) & (F.col("created_at") < now_ms - older_than_days * DAY_MS))
    return without_links(old, *links).withColumn("weight", weight).orderBy("weight", "created_at", "id")


def clusters(memory: DataFrame, edges: DataFrame, min_size: int = 2, members: int = 5, found: DataFrame | None = None) -> DataFrame:
    """community, size, representatives, common terms and the summary that covers most of it. ``found`` are the communities of live rows, where they are known."""
    rows = live(memory).select("id", "title", "importance")
    if found is None:
        inside = edges.join(rows.select(F.col("id").alias("src")), "src", "left_semi").join(rows.select(F.col("id").alias("dst")), "dst", "left_semi")
        found = keep(communities(inside.select("src", "dst", "weight")), "clusters")
    named = found.join(rows.withColumnRenamed("id", "node"), "node")
    size = named.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    lead = top(named.select("community", "node", "importance"), "community", members, F.desc("importance"), F.asc("node")).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("representatives"))
    words = common_terms(named.select("community", F.col("node").alias("id"), "title"))
    derived = edges.where("type = 'DERIVED_FROM'").select(F.col("src").alias("summary"), F.col("dst").alias("node")).join(found, "node").groupBy("community", "summary").agg(F.count_distinct("node").alias("covers")).where("covers >= 2")
    best = derived.groupBy("community").agg(F.min(F.struct((-F.col("covers")).alias("less"), "summary")).alias("b")).select("community", F.col("b.summary").alias("summary"))
    return size.join(lead, "community").join(words, "community", "left").join(best, "community", "left")


def common_terms(rows: DataFrame, most: int = 6) -> DataFrame:
    """community and the title words longer than three characters that at least two of its rows share."""
    words = rows.select("community", "id", F.explode(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"))).alias("term")).where(F.length("term") > 3)
    counted = words.groupBy("community", "term").agg(F.count("*").alias("n")).where("n > 1")
    return top(counted, "community", most, F.desc("n"), F.asc("term")).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


def changes(files: DataFrame, memory: DataFrame, about: DataFrame, symbol: DataFrame, calls: DataFrame, edges: DataFrame, per_file: int = 5) -> DataFrame:
    """path, memory_id, via, contested, rank: what is recorded about changed files and about callers into them.

    Artifacts give way where there is reasoning on the same file; ``per_file`` rows per file and way.
    """
    rows = live(memory).select(F.col("id").alias("memory_id"), "layer", "importance", "file_path", "source_ref")
    parts = F.split("source_ref", "#")
    refs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "#"))
    places = F.array_distinct(F.filter(F.concat(F.array("file_path"), F.when(F.contains("source_ref", F.lit("#")), refs).otherwise(F.array().cast("array<string>"))), lambda p: p.isNotNull()))
    direct = files.join(rows.withColumn("path", F.explode(places)), "path").select("path", "memory_id", "layer", "importance", F.lit("anchor").alias("via"))
    into = symbol.join(files, symbol["file_path"] == files["path"]).select("path", F.col("id").alias("dst"))
    onto = into.join(calls.select("src", "dst"), "dst").select("path", F.col("src").alias("symbol_id")).distinct().join(about.select("memory_id", "symbol_id"), "symbol_id").join(rows.drop("file_path", "source_ref"), "memory_id").select("path", "memory_id", "layer", "importance", F.lit("call").alias("via"))
    both = direct.unionByName(onto).distinct()
    reasoned = F.max(F.col("layer") != "artifact").over(W.partitionBy("path"))
    kept = both.withColumn("reasoned", reasoned).where(~F.col("reasoned") | (F.col("layer") != "artifact"))
    fought = edges.where("type = 'CONTRADICTS'").select(F.col("src").alias("memory_id")).union(edges.where("type = 'CONTRADICTS'").select("dst")).distinct().withColumn("contested", F.lit(True))
    marked = kept.join(fought, "memory_id", "left").withColumn("contested", F.coalesce("contested", F.lit(False)))
    return top(marked.select("path", "memory_id", "layer", "importance", "via", "contested"), ["path", "via"], per_file, F.desc("importance"), F.asc("memory_id"))


def uncovered(files: DataFrame, found: DataFrame) -> DataFrame:
    """Changed files about which nothing is recorded."""
    return files.join(found.select("path").distinct(), "path", "left_anti")


def summarize(cluster: DataFrame, summary_id: str, now_ms: int) -> DataFrame:
    """The edges that make a note the summary of a cluster's nodes."""
    return cluster.select(F.lit(summary_id).alias("src"), F.col("node").alias("dst"), F.lit("DERIVED_FROM").alias("type"), F.lit(1.0).alias("weight"), F.lit(now_ms).cast("long").alias("created_at"), F.lit(None).cast("string").alias("evidence_ref"))


def add_edges(edges: DataFrame, new: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the new ones, and the refused ones with the reason: an unknown type or an end that does not exist."""
    ids = memory.select("id")
    checked = new.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("d")), "dst", "left")
    reason = F.when(~F.col("type").isin(*EDGE_TYPES), F.concat(F.lit("unknown type "), "type")).when(F.col("s").isNull(), F.concat(F.lit("no node "), "src")).when(F.col("d").isNull(), F.concat(F.lit("no node "), "dst"))
    told = checked.withColumn("reason", reason).select(*new.columns, "reason")
    fresh = told.where("reason IS NULL").drop("reason").dropDuplicates(["src", "dst", "type"]).join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    return edges.unionByName(fresh.select(*edges.columns)), told.where("reason IS NOT NULL")


def status(memory: DataFrame, edges: DataFrame, symbol: DataFrame) -> DataFrame:
    """metric, key, count: what a store holds."""
    by = lambda df, metric, key: df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("count")).select(F.lit(metric).alias("metric"), "key", "count")
    space = F.concat_ws("/", "embedding_model", F.col("embedding_dims").cast("string"), "embedding_provider")
    return by(memory, "layer", F.col("layer")).unionByName(by(edges, "edge", F.col("type"))).unionByName(by(symbol, "symbol", F.col("kind"))).unionByName(by(memory.where("embedding IS NOT NULL"), "space", space))


def doctor(spark: SparkSession, memory: DataFrame, edges: DataFrame, symbol: DataFrame, calls: DataFrame, pending: DataFrame, doc_len: DataFrame, *, tokenizer_version: int = TOKENIZER_VERSION) -> DataFrame:
    """check, status, detail: one aggregate per check, so that a check that can't run does not hide the rest."""
    rows = live(memory)
    ids = memory.select("id")
    counts = {
        "nodes": rows.agg(F.count("*").alias("n")),
        "dangling edges": edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns), allowMissingColumns=True).agg(F.count("*").alias("n")),
        "vectors missing": rows.where("embedding IS NULL").agg(F.count("*").alias("n")),
        "vector spaces": rows.where("embedding IS NOT NULL").select("embedding_model", "embedding_dims", "embedding_provider").distinct().agg(F.count("*").alias("n")),
        "index lag": rows.select("id").join(doc_len.select(F.col("node_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("n")),
        "orphans": orphans(memory, edges).agg(F.count("*").alias("n")),
        "unanchored": rows.where("source_ref IS NULL").agg(F.count("*").alias("n")),
        "calls": calls.agg(F.count("*").alias("n")),
        "ambiguous": pending.where("reason = 'ambiguous'").agg(F.count("*").alias("n")),
        "symbols": symbol.agg(F.count("*").alias("n")),
    }
    told = None
    for name, df in counts.items():
        part = df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"))
        told = part if told is None else told.unionByName(part)
    wide = told.groupBy().pivot("check", list(counts)).agg(F.first("n"))
    rate = F.col("calls") / F.nullif(F.col("calls") + F.col("ambiguous"), F.lit(0))
    ok = lambda good: F.when(good, "ok").otherwise("warn")
    lines = [
        ("nodes", F.when(F.col("nodes") > 0, "ok").otherwise("empty"), F.col("nodes")),
        ("dangling edges", ok(F.col("dangling edges") == 0), F.col("dangling edges")),
        ("vectors missing", ok(F.col("vectors missing") == 0), F.col("vectors missing")),
        ("vector spaces", ok(F.col("vector spaces") <= 1), F.col("vector spaces")),
        ("index lag", ok(F.col("index lag") == 0), F.col("index lag")),
        ("tokenizer version", F.lit("ok" if tokenizer_version == TOKENIZER_VERSION else "warn"), F.lit(tokenizer_version)),
        ("orphans", ok(F.col("orphans") == 0), F.col("orphans")),
        ("unanchored", ok(F.col("unanchored") == 0), F.col("unanchored")),
        ("resolve rate", F.when(rate.isNull(), "empty").otherwise(ok(rate >= 0.8)), F.round(100 * rate).cast("long")),
        ("symbols", F.when(F.col("symbols") > 0, "ok").otherwise("empty"), F.col("symbols")),
    ]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), s.alias("status"), d.cast("string").alias("detail")) for n, s, d in lines])).alias("x")).select("x.*")
