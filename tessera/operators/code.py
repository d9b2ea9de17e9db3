"""The code graph: resolving names, impact, context, traces, flows, queries, changes, renames, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.paths import CALLABLE_KIND, CONSTRUCTIBLE_KIND, CRITICAL, IDENTIFIER, TYPE_KIND, directory_of, is_test_path, module_of, parent_id, qualified_name
from tessera.functions.scores import confidence_value, word_score
from tessera.functions.text import tokenize
from tessera.graph.frontier import path_to
from tessera.graph.frontier import search as breadth_first
from tessera.graph.structure import communities, strong_components
from tessera.operators.index import top
from tessera.operators.memory import without_links
from tessera.operators.pairs import spelled_out
from tessera.operators.spans import overlapping
from tessera.session import keep


def containment(symbol: DataFrame) -> DataFrame:
    """parent, child: what ids say of nesting, where the container exists. As large as the code, so it is joined by sorting."""
    child = symbol.select(F.col("id").alias("child"), parent_id(F.col("id")).alias("parent")).where("parent IS NOT NULL")
    return child.join(symbol.select(F.col("id").alias("parent")).hint("merge"), "parent", "left_semi").select("parent", "child").hint("merge")


def degrees(calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """id, degree over calls and inheritance, both ways."""
    ends = [df.select(F.col(c).alias("id")) for df in (calls, inherits) for c in ("src", "dst")]
    every = ends[0]
    for e in ends[1:]:
        every = every.unionByName(e)
    return every.groupBy("id").agg(F.count("*").alias("degree"))


# --- names -------------------------------------------------------------------------------------


def resolve_targets(asked: DataFrame, symbol: DataFrame, calls: DataFrame, inherits: DataFrame, suggestions: int = 5) -> DataFrame:
    """query_id, status (ok, ambiguous, not_found), id, rank, for a batch of query_id, name, uid, file.

    A uid wins; then file:qualified; a dotted suffix; the exact name; the name in any case. ``file`` keeps what ends in it. More than one
    match is answered with all of them, outside tests and best connected first; none with names that contain it. What is asked alike is
    answered once, and the answers are dealt out to those who asked. Declarations are as many as the code is large, whatever the planner takes their files for, so
    none of their tables is broadcast.
    """
    told = asked.withColumn("question", F.to_json(F.struct("name", "uid", "file")))
    once = told.select(F.col("question").alias("query_id"), "name", "uid", "file").distinct()
    answers = _resolved_once(once, symbol, calls, inherits, suggestions).withColumnRenamed("query_id", "question")
    return spelled_out(keep(told.select("query_id", "question").distinct(), "asked"), keep(answers, "answers"), ["question"]).select("query_id", "status", "id", "rank")


def _resolved_once(asked: DataFrame, symbol: DataFrame, calls: DataFrame, inherits: DataFrame, suggestions: int) -> DataFrame:
    s = symbol.select("id", F.col("name").alias("s_name"), "file_path", qualified_name(F.col("id")).alias("qualified")).hint("merge")
    a = asked.select("query_id", "name", "uid", "file")
    low, tail = F.lower("name"), F.lower("s_name")
    # what could fit shares a key: the id, or the last part of the name in lower case
    last = F.regexp_replace(low, r"^.*[.:]", "")
    keyed = a.withColumn("key", F.explode(F.array_distinct(F.filter(F.array(F.concat(F.lit("u "), "uid"), F.concat(F.lit("n "), low), F.concat(F.lit("n "), last)), lambda k: k.isNotNull()))))
    held = s.withColumn("key", F.explode(F.array(F.concat(F.lit("u "), "id"), F.concat(F.lit("n "), tail))))
    pairs = held.join(keyed, "key").drop("key").distinct()
    given = F.coalesce("name", F.lit(""))
    way = (
        F.when(F.col("uid") == F.col("id"), 0)
        .when(given == F.concat_ws(":", "file_path", "qualified"), 1)
        .when(given.contains(".") & ((F.col("qualified") == given) | F.col("qualified").endswith(F.concat(F.lit("."), given))), 2)
        .when(given == F.col("s_name"), 3)
        .when(low == tail, 4)
    )
    fits = pairs.withColumn("way", way).where("way IS NOT NULL").where(F.col("file").isNull() | F.col("file_path").endswith(F.col("file")))
    first = fits.withColumn("least", F.min("way").over(W.partitionBy("query_id"))).where("way = least").select("query_id", "id", "file_path")
    linked = first.join(degrees(calls, inherits).hint("merge"), "id", "left")
    order = W.partitionBy("query_id").orderBy(is_test_path(F.col("file_path")).cast("int"), F.desc(F.coalesce("degree", F.lit(0))), "file_path", "id")
    found = linked.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("query_id"))).select("query_id", F.when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("status"), "id", "rank")
    missing = a.join(found.select("query_id").distinct().hint("merge"), "query_id", "left_anti")
    # a name that contains another holds its first three letters somewhere; names are matched once, whatever they are the names of
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(tail)), lambda i: F.substring(tail, i, F.lit(3))))
    short = F.flatten(F.transform(grams, lambda g: F.array(g, F.substring(g, 1, 2), F.substring(g, 1, 1))))
    names = s.where(F.length("s_name") > 0).select("s_name").distinct().withColumn("key", F.explode(F.array_distinct(short)))
    named = names.join(missing.withColumn("key", F.substring(low, 1, 3)), "key").where(tail.contains(low)).select("query_id", "s_name").distinct()
    hit = s.select("id", "s_name").join(named, "s_name").select("query_id", "id", F.col("s_name").alias("hit")).distinct()
    like = missing.select("query_id").join(hit.hint("merge"), "query_id", "left").withColumn("status", F.lit("not_found"))
    hints = like.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("hit", "id"))).where(F.col("rank") <= suggestions).select("query_id", "status", "id", "rank")
    return found.unionByName(hints)


#: What declarations are counted as: any, callable, constructible.
KINDS = ("all", "call", "new")


def _summary(rows: DataFrame, *keys: Column) -> DataFrame:
    """For each key how many declarations there are, of any kind, callable and constructible, and the largest id of each."""
    of = {"all": F.lit(True), "call": F.col("callable"), "new": F.col("constructible")}
    counts = [a for k, test in of.items() for a in (F.count_if(test).alias(f"n_{k}"), F.max(F.when(test, F.col("id"))).alias(f"id_{k}"))]
    return rows.groupBy(*keys).agg(*counts)


def _merged(summaries: DataFrame, *keys: str) -> DataFrame:
    """Summaries of several places added up."""
    return summaries.groupBy(*keys).agg(*(a for k in KINDS for a in (F.sum(f"n_{k}").alias(f"n_{k}"), F.max(f"id_{k}").alias(f"id_{k}"))))


def _united(summaries: DataFrame, *keys: str) -> DataFrame:
    """Summaries of owners brought together, where one owner may come more than once: the least and the largest owner tell whether it is a single one."""
    least, most = (lambda c: F.min(c).alias(c)), (lambda c: F.max(c).alias(c))
    return summaries.groupBy(*keys).agg(*(a for k in KINDS for a in (most(f"n_{k}"), most(f"id_{k}"), least(f"lo_{k}"), most(f"hi_{k}"))))


def choose(sites: DataFrame, symbol: DataFrame, imports: DataFrame, visible: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """call_id, id, confidence, reason: the declaration that each call site means.

    ``sites`` has call_id (unique), file_path, name, kind (call or new), receiver, receiver_type. Candidates share the name; those of a
    fitting kind count if there are any. The first rule that leaves exactly one wins: the receiver's type, the same file, the receiver's
    name as owner, an imported file, a visible container (``visible``: file_path, container), being the only one. Else the reason is
    external (no candidate) or ambiguous.

    Rules ask only how many candidates there are and, if it is one, which. So declarations are counted by name, by name and file, and by name and owner; a site
    looks its counts up, one row for each rule, and never meets the candidates. Imports and visible containers add up the counts of their
    places for the (file, name) pairs that are asked for. With ``members`` (container, owner) a container is a namespace and holds types: its counts are added up
    once for all files that see it, and a type that lies in two of them is one.
    """
    owner = F.regexp_extract(qualified_name(F.col("id")), r"([^.]*)\.[^.]*$", 1)
    s = symbol.where("id IS NOT NULL AND name IS NOT NULL").select("id", "name", F.col("file_path").alias("where"), F.coalesce(F.col("kind").rlike(CALLABLE_KIND), F.lit(False)).alias("callable"), F.coalesce(F.col("kind").rlike(CONSTRUCTIBLE_KIND), F.lit(False)).alias("constructible"), owner.alias("owner")).distinct()
    by_file, by_owner = _summary(s, F.col("name"), F.col("where")), _summary(s, F.col("name"), F.col("owner"))
    asked = sites.select("file_path", "name").distinct()
    near = imports.select(F.col("src").alias("file_path"), F.col("dst").alias("where")).distinct()
    lookups = {
        "type": (by_owner.withColumnRenamed("owner", "receiver_type"), ["name", "receiver_type"]),
        "file": (by_file.withColumnRenamed("where", "file_path"), ["name", "file_path"]),
        "receiver": (by_owner.withColumnRenamed("owner", "receiver"), ["name", "receiver"]),
        "import": (_merged(asked.join(near, "file_path").join(by_file, ["name", "where"]), "name", "file_path"), ["name", "file_path"]),
        "unique": (_summary(s, F.col("name")), ["name"]),
    }
    if visible is not None:
        told = by_owner.select("name", "owner", *(c for k in KINDS for c in (f"n_{k}", f"id_{k}", F.when(F.col(f"n_{k}") > 0, F.col("owner")).alias(f"lo_{k}"), F.when(F.col(f"n_{k}") > 0, F.col("owner")).alias(f"hi_{k}"))))
        held = told.withColumnRenamed("owner", "container") if members is None else _united(members.select("container", "owner").distinct().join(told, "owner"), "container", "name")
        seen = _united(asked.join(visible.select("file_path", "container").distinct(), "file_path").join(held, ["name", "container"]), "name", "file_path")
        several = lambda k: F.when(F.col(f"lo_{k}") == F.col(f"hi_{k}"), F.col(f"n_{k}")).when(F.col(f"lo_{k}").isNotNull(), 2).otherwise(0)
        lookups["visible"] = (seen.select("name", "file_path", *(c for k in KINDS for c in (several(k).alias(f"n_{k}"), F.col(f"id_{k}")))), ["name", "file_path"])
    c = sites.select("call_id", "file_path", "name", F.col("kind").alias("use"), "receiver", "receiver_type")
    for rule, (counts, keys) in lookups.items():
        c = c.join(counts.select(*keys, F.struct(*(x for x in counts.columns if x not in keys)).alias(f"of_{rule}")), keys, "left")
    new = F.col("use") == "new"
    fitting = F.coalesce(F.when(new, F.col("of_unique.n_new")).otherwise(F.col("of_unique.n_call")), F.lit(0)) > 0

    def pick(rule: str, what: str) -> Column:
        return F.when(fitting, F.when(new, F.col(f"of_{rule}.{what}_new")).otherwise(F.col(f"of_{rule}.{what}_call"))).otherwise(F.col(f"of_{rule}.{what}_all"))

    chosen, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed([r for r in ("type", "file", "receiver", "import", "visible", "unique") if r in lookups]):
        one = pick(rule, "n") == 1
        chosen = F.when(one, pick(rule, "id")).otherwise(chosen)
        label = F.when(one, F.lit("import" if rule == "visible" else rule)).otherwise(label)
    return c.select("call_id", chosen.alias("id"), label.alias("confidence"), F.when(F.coalesce("of_unique.n_all", F.lit(0)) == 0, "external").when(chosen.isNull(), "ambiguous").alias("reason"))


#: Suffixes tried on an imported path, nearest to the text first (fixed values).
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".kt", ".cs", ".rb", ".php", ".swift", ".scala", ".c", ".h", ".cpp", ".hpp", ".vue", ".dart", "/index.ts", "/index.js", "/__init__.py", "/mod.rs")


def resolve_imports(asked: DataFrame, file: DataFrame) -> DataFrame:
    """src, module, dst: the file that an import names, for src, module, path (as joined to the importing file's folder).

    The first existing path over the suffixes; else the only file of that base name.
    """
    tried = asked.select("*", F.posexplode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("priority", "suffix"))
    exact = tried.withColumn("dst", F.concat("path", "suffix")).join(file.select(F.col("path").alias("dst")), "dst").groupBy("src", "module").agg(F.min_by("dst", "priority").alias("exact"))
    base = lambda c: F.regexp_replace(F.regexp_replace(c, "^.*/", ""), r"\.[^.]*$", "")
    alone = file.groupBy(base(F.col("path")).alias("base")).agg(F.count("*").alias("n"), F.max("path").alias("alone")).where("n = 1")
    out = asked.join(exact, ["src", "module"], "left").withColumn("base", base(F.col("path"))).join(alone, "base", "left")
    return out.select("src", "module", F.coalesce("exact", "alone").alias("dst"))


def reopen_calls(calls: DataFrame, symbol: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls without those into or out of deleted symbols; and the calls into them, pending again as external."""
    dead = gone.select("id")
    into = calls.join(dead.withColumnRenamed("id", "dst"), "dst", "left_semi").join(dead.withColumnRenamed("id", "src"), "src", "left_anti")
    left = calls.join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti").join(dead.withColumnRenamed("id", "src"), "src", "left_anti")
    where = symbol.select(F.col("id").alias("src"), "file_path")
    pending = into.join(where, "src").select(
        F.concat_ws(":", "src", "name", F.col("line").cast("string")).alias("id"), "file_path", F.col("src").alias("from_symbol"), "name", F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("receiver_type"), "line", F.lit("call").alias("kind"), F.lit("external").alias("reason")
    )
    return left.select(*calls.columns), pending


# --- walks -------------------------------------------------------------------------------------


def _tests(symbol: DataFrame) -> DataFrame:
    return symbol.where(is_test_path(F.col("file_path"))).select("id").hint("merge")


def dependency_edges(symbol: DataFrame, calls: DataFrame, inherits: DataFrame, direction: str = "upstream", min_confidence: float = 0.0) -> DataFrame:
    """src, dst, confidence, via: the edges that impact walks, with containers standing for their members."""
    call = calls.select("src", "dst", confidence_value(F.col("confidence")).alias("confidence"), F.lit("CALLS").alias("via"))
    heir = inherits.select("src", "dst", confidence_value(F.col("confidence")).alias("confidence"), F.lit("INHERITS").alias("via"))
    strong = call.unionByName(heir).where(F.col("confidence") >= min_confidence).groupBy("src", "dst", "via").agg(F.max("confidence").alias("confidence")).select("src", "dst", "confidence", "via")
    member = containment(symbol)
    if direction == "upstream":
        back = strong.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence", "via")
        through = back.join(member.select(F.col("child").alias("src"), "parent"), "src").where("parent <> dst").select(F.col("parent").alias("src"), "dst", "confidence", F.lit("MEMBER").alias("via"))
    else:
        back = strong
        through = strong.join(member.select(F.col("child").alias("src"), "parent"), "src").where("parent <> dst").select(F.col("parent").alias("src"), "dst", "confidence", F.lit("MEMBER").alias("via"))
    return back.unionByName(through)


def impact(targets: DataFrame, symbol: DataFrame, calls: DataFrame, inherits: DataFrame, *, direction: str = "upstream", max_depth: int = 3, min_confidence: float = 0.0, include_tests: bool = False) -> DataFrame:
    """source, node, depth, confidence, parent, via, label for a batch of targets (column id)."""
    edges = dependency_edges(symbol, calls, inherits, direction, min_confidence)
    if not include_tests:
        edges = edges.join(_tests(symbol).withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "confidence", "via")
    found = breadth_first(edges, targets.select(F.col("id").alias("source"), F.col("id").alias("node")), max(1, min(5, max_depth))).where("depth > 0")
    label = F.when(F.col("depth") == 1, "WILL BREAK").when(F.col("depth") == 2, "LIKELY AFFECTED").when(F.col("depth") == 3, "MAY NEED TESTING").otherwise("TRANSITIVE")
    return found.withColumn("confidence", F.round("confidence", 4)).withColumn("label", label)


def impact_summary(targets: DataFrame, found: DataFrame, symbol: DataFrame, calls: DataFrame, inherits: DataFrame, imports: DataFrame, min_confidence: float = 0.0, include_tests: bool = False) -> DataFrame:
    """source, symbols, direct, risk, importing files, tests skipped, edges dropped below the confidence."""
    where = symbol.select(F.col("id").alias("node"), "file_path")
    own = targets.select(F.col("id").alias("source")).distinct().join(where.withColumnRenamed("node", "source"), "source")
    near = found.where("depth = 1").join(where, "node").select("source", F.concat_ws(" ", qualified_name(F.col("node")), "file_path").alias("t"))
    grave = near.unionByName(own.select("source", F.concat_ws(" ", qualified_name(F.col("source")), "file_path").alias("t"))).groupBy("source").agg(F.max(F.col("t").rlike(CRITICAL)).alias("critical"))
    counts = found.groupBy("source").agg(F.count("*").alias("symbols"), F.count_if(F.col("depth") == 1).alias("direct"))
    files = own.join(imports.select("src", F.col("dst").alias("file_path")), "file_path").where(F.lit(include_tests) | ~is_test_path(F.col("src"))).groupBy("source").agg(F.array_sort(F.collect_set("src")).alias("importing_files"))
    back = calls.select(F.col("dst").alias("source"), F.col("src").alias("id"), "confidence").unionByName(inherits.select(F.col("dst").alias("source"), F.col("src").alias("id"), "confidence"))
    weak = back.where(confidence_value(F.col("confidence")) < min_confidence).groupBy("source").agg(F.count("*").alias("dropped"))
    tests = back.join(_tests(symbol), "id", "left_semi").groupBy("source").agg(F.count_distinct("id").alias("tests_skipped"))
    out = own.select("source").join(counts, "source", "left").join(grave, "source", "left").join(files, "source", "left").join(weak, "source", "left").join(tests, "source", "left")
    n = F.coalesce("symbols", F.lit(0))
    risk = F.when(F.col("critical"), "CRITICAL").when(n < 5, "LOW").when(n <= 15, "MEDIUM").otherwise("HIGH")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", n.alias("symbols"), zero("direct"), risk.alias("risk"), F.coalesce("importing_files", F.array().cast("array<string>")).alias("importing_files"), zero("dropped"), zero("tests_skipped") if not include_tests else F.lit(0).alias("tests_skipped"))


def context(targets: DataFrame, symbol: DataFrame, calls: DataFrame, inherits: DataFrame, imports: DataFrame, about: DataFrame | None = None, most_memories: int = 20) -> DataFrame:
    """source, relation, other: everything one step from a declaration."""
    t = targets.select(F.col("id").alias("source")).distinct()
    member, files = containment(symbol), symbol.select(F.col("id").alias("source"), "file_path")
    one = lambda df, here, there, name: t.join(df.select(F.col(here).alias("source"), F.col(there).alias("other")), "source").select("source", F.lit(name).alias("relation"), "other")
    parts = [one(member, "child", "parent", "container"), one(member, "parent", "child", "member"), one(calls, "dst", "src", "caller"), one(calls, "src", "dst", "callee"), one(inherits, "src", "dst", "base"), one(inherits, "dst", "src", "derived")]
    own = t.join(files, "source")
    parts.append(own.join(imports, own["file_path"] == imports["src"]).select("source", F.lit("imports").alias("relation"), F.col("dst").alias("other")))
    parts.append(own.join(imports, own["file_path"] == imports["dst"]).select("source", F.lit("imported_by").alias("relation"), F.col("src").alias("other")))
    if about is not None:
        noted = top(one(about.withColumnRenamed("memory_id", "m"), "symbol_id", "m", "memory"), "source", most_memories, F.asc("other")).drop("rank")
        parts.append(noted)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def trace(pairs: DataFrame, symbol: DataFrame, calls: DataFrame, *, max_depth: int = 10, include_tests: bool = False) -> DataFrame:
    """source, target, status, hops, path, vias: the shortest way over calls and members; tests may end a way but not carry it. Tables that grow with the code are not broadcast.

    Without a way: status no_path, the node reached farthest as the only one of the path, and whether depth cut the search.
    """
    depth = max(1, min(30, max_depth))
    member = containment(symbol).select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1.0).alias("confidence"), F.lit("HAS_MEMBER").alias("via"))
    edges = calls.select("src", "dst", confidence_value(F.col("confidence")).alias("confidence"), F.lit("CALLS").alias("via")).unionByName(member)
    if not include_tests:
        edges = edges.join(_tests(symbol).withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "confidence", "via")
    asked = pairs.select("source", "target").distinct()
    found = breadth_first(edges, asked.select("source", F.col("source").alias("node")), depth, stop_at=asked.select("source", F.col("target").alias("node")))
    hit = found.join(asked.withColumnRenamed("target", "node").hint("merge"), ["source", "node"], "left_semi")
    ways = path_to(found, hit.select("source", "node"), depth)
    last = found.groupBy("source").agg(F.max(F.struct("depth", F.col("node"))).alias("far")).hint("merge")
    out = asked.join(ways.hint("merge"), ["source", "target"], "left").join(last, "source", "left")
    ok = F.col("path").isNotNull()
    return out.select(
        "source", "target", F.when(ok, "ok").otherwise("no_path").alias("status"), F.when(ok, F.size("path") - 1).alias("hops"), F.when(ok, F.col("path")).otherwise(F.array("far.node")).alias("path"),
        F.col("vias"), (~ok & (F.col("far.depth") >= depth)).alias("truncated"),
    )


def entry_points(symbol: DataFrame, calls: DataFrame, include_tests: bool = False) -> DataFrame:
    """id, out_degree of callables that nothing calls and that call something, busiest first."""
    rows = symbol.where(~F.col("kind").rlike(TYPE_KIND))
    if not include_tests:
        rows = rows.where(~is_test_path(F.col("file_path")))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    free = rows.select("id").join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return free.join(out, "id").orderBy(F.desc("out_degree"), "id")


def flows(symbol: DataFrame, calls: DataFrame, *, max_depth: int = 6, max_steps: int = 60, max_flows: int = 400, include_tests: bool = False) -> DataFrame:
    """process_id, symbol_id, depth, via, step, truncated, omitted: what each entry point sets off, as one keyed search.

    The busiest ``max_flows`` entry points are followed; omitted is how many more there are.
    """
    every = entry_points(symbol, calls, include_tests)
    entries = every.limit(max_flows)
    more = every.agg(F.greatest(F.lit(0), F.count("*") - max_flows).alias("omitted"))
    member = containment(symbol).select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1.0).alias("confidence"), F.lit("MEMBER").alias("via"))
    edges = calls.select("src", "dst", confidence_value(F.col("confidence")).alias("confidence"), F.lit("CALLS").alias("via")).unionByName(member)
    if not include_tests:
        edges = edges.join(_tests(symbol).withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "confidence", "via")
    found = breadth_first(edges, entries.select(F.col("id").alias("source"), F.col("id").alias("node")), max_depth).where("depth > 0")
    step = F.row_number().over(W.partitionBy("source").orderBy("depth", F.desc("confidence"), "node"))
    cut = F.count("*").over(W.partitionBy("source")) > max_steps
    return found.withColumn("step", step).withColumn("truncated", cut).where(F.col("step") <= max_steps).crossJoin(F.broadcast(more)).select(F.regexp_replace("source", "^Symbol:", "Process:").alias("process_id"), F.col("node").alias("symbol_id"), "depth", "via", "step", "truncated", "omitted")


def flows_of(found: DataFrame, ids: DataFrame) -> DataFrame:
    """process_id, depth: flows that reach any of the symbols, at their least depth."""
    return found.join(ids.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi").groupBy("process_id").agg(F.min("depth").alias("depth"))


def resolve_flow(found: DataFrame, name: str, suggestions: int = 5) -> DataFrame:
    """process_id, status of the flows of a name: ok, ambiguous, or not_found with those that contain it."""
    every = found.select("process_id").distinct().withColumn("label", F.regexp_replace("process_id", r"^.*[:.]", ""))
    exact = every.where((F.col("process_id") == name) | (F.lower("label") == name.lower()))
    n = exact.count()
    if n:
        return exact.select("process_id", F.lit("ok" if n == 1 else "ambiguous").alias("status"))
    return every.where(F.lower("label").contains(name.lower())).orderBy("process_id").limit(suggestions).select("process_id", F.lit("not_found").alias("status"))


def query(questions: DataFrame, symbol: DataFrame, found: DataFrame, about: DataFrame | None = None, *, limit: int = 20, include_tests: bool = False) -> DataFrame:
    """query_id, id, score, rank, process_id, memories: declarations that fit a question, by the flow they take part in."""
    rows = symbol if include_tests else symbol.where(~is_test_path(F.col("file_path")))
    words = lambda c: tokenize(F.regexp_replace(c, r"[_./\\-]+", " "))
    q = questions.select("query_id", F.array_distinct(words(F.col("text"))).alias("terms"))
    # a word that scores begins like one of the question: both have its first two letters as a key
    heads = lambda c: F.array_distinct(F.transform(c, lambda w: F.substring(w, 1, 2)))
    named = rows.select("id", words(F.col("name")).alias("in_name"), words(F.col("file_path")).alias("in_path"))
    pairs = named.withColumn("key", F.explode(heads(F.concat("in_name", "in_path")))).join(q.withColumn("key", F.explode(heads(F.col("terms")))).hint("broadcast"), "key")
    scored = pairs.dropDuplicates(["query_id", "id"])
    hits = top(scored.select("query_id", "id", word_score(F.col("terms"), F.col("in_name"), F.col("in_path")).alias("score")).where("score > 0"), "query_id", max(1, min(200, limit)), F.desc("score"), F.asc("id"))
    entry = found.select("process_id", F.regexp_replace("process_id", "^Process:", "Symbol:").alias("id"), F.lit(0).alias("depth")).distinct()
    part = found.select("process_id", F.col("symbol_id").alias("id"), "depth").unionByName(entry)
    flow = hits.join(part, "id").groupBy("query_id", "id").agg(F.min(F.struct("depth", "process_id")).alias("f")).select("query_id", "id", F.col("f.process_id").alias("process_id"))
    out = hits.join(flow, ["query_id", "id"], "left")
    if about is None:
        return out.withColumn("memories", F.array().cast("array<string>"))
    noted = about.groupBy(F.col("symbol_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set("memory_id")), 1, 5).alias("memories"))
    return out.join(noted, "id", "left").withColumn("memories", F.coalesce("memories", F.array().cast("array<string>")))


# --- changes -----------------------------------------------------------------------------------


def _touched(hunks: DataFrame, symbol: DataFrame) -> DataFrame:
    """Hunks with the symbols that their old side overlaps; a pure insertion touches the line that it follows."""
    last = F.when(F.col("old_lines") == 0, F.col("old_start")).otherwise(F.col("old_start") + F.col("old_lines") - 1)
    s = symbol.select(F.col("file_path").alias("file"), "id", "start_line", "end_line")
    return overlapping(hunks, s, (F.col("old_start"), last), (F.col("start_line"), F.col("end_line")), "file")


def changed_symbols(hunks: DataFrame, symbol: DataFrame) -> DataFrame:
    """id, file, change (modified or removed), is_test: hunks and symbols meet by blocks of lines."""
    h = hunks.withColumn("file_deleted", F.min((F.col("status") == "deleted").cast("int")).over(W.partitionBy("file")) == 1)
    hit = _touched(h, symbol)
    swallowed = (F.col("old_start") <= F.col("start_line")) & (F.col("old_start") + F.col("old_lines") - 1 >= F.col("end_line")) & (F.col("new_lines") == 0)
    return hit.groupBy("id", "file").agg(F.max(swallowed | F.col("file_deleted")).alias("gone")).select("id", "file", F.when(F.col("gone"), "removed").otherwise("modified").alias("change"), is_test_path(F.col("file")).alias("is_test"))


def changed_files(hunks: DataFrame, symbol: DataFrame) -> DataFrame:
    """file, symbols, unmatched_hunks, unindexed, is_test."""
    h = hunks.withColumn("hunk", F.struct("old_start", "old_lines", "new_start", "new_lines"))
    hit = _touched(h, symbol)
    matched = hit.groupBy("file").agg(F.count_distinct("id").alias("symbols"), F.count_distinct("hunk").alias("matched"))
    known = symbol.select(F.col("file_path").alias("file"), F.lit(True).alias("known")).distinct()
    every = h.groupBy("file").agg(F.count_distinct("hunk").alias("hunks"))
    out = every.join(matched, "file", "left").join(known, "file", "left")
    return out.select("file", F.coalesce("symbols", F.lit(0)).alias("symbols"), (F.col("hunks") - F.coalesce("matched", F.lit(0))).alias("unmatched_hunks"), F.col("known").isNull().alias("unindexed"), is_test_path(F.col("file")).alias("is_test"))


RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def worst(risk: Column) -> Column:
    """The worst of an ordered enum, as an aggregate."""
    return F.element_at(F.array(*[F.lit(r) for r in RISKS]), F.max(F.array_position(F.array(*[F.lit(r) for r in RISKS]), risk)).cast("int"))


def detect_changes(hunks: DataFrame, symbol: DataFrame, calls: DataFrame, inherits: DataFrame, imports: DataFrame, found: DataFrame, *, max_depth: int = 2, include_tests: bool = False) -> DataFrame:
    """id, file, change, symbols, direct, risk, processes: every changed declaration with what depends on it."""
    hit = changed_symbols(hunks, symbol)
    hit = hit if include_tests else hit.where("NOT is_test")
    blast = impact(hit, symbol, calls, inherits, max_depth=max(1, min(3, max_depth)), include_tests=include_tests)
    told = impact_summary(hit, blast, symbol, calls, inherits, imports, include_tests=include_tests).withColumnRenamed("source", "id")
    entry = found.select("process_id", F.regexp_replace("process_id", "^Process:", "Symbol:").alias("symbol_id")).distinct()
    flow = found.select("process_id", "symbol_id").unionByName(entry).groupBy(F.col("symbol_id").alias("id")).agg(F.array_sort(F.collect_set("process_id")).alias("processes"))
    out = hit.join(told, "id").join(flow, "id", "left")
    return out.select("id", "file", "change", "symbols", "direct", "risk", F.coalesce("processes", F.array().cast("array<string>")).alias("processes"))


def module_rollup(files: DataFrame, file_col: str = "file", symbols_col: str = "symbols") -> DataFrame:
    return files.groupBy(module_of(F.col(file_col)).alias("module")).agg(F.count("*").alias("files"), F.sum(symbols_col).alias("symbols"))


def reviewers(history: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """author, commits, files: who has worked most on the changed files."""
    mine = history.join(files.select("file").distinct(), "file", "left_semi")
    return mine.groupBy("author").agg(F.sum("commits").alias("commits"), F.count_distinct("file").alias("files")).orderBy(F.desc("commits"), F.desc("files"), "author").limit(most)


def breaking(changed: DataFrame) -> DataFrame:
    """Changes that something outside depends on, removals first."""
    return changed.where("direct > 0").orderBy(F.desc(F.col("change") == "removed"), F.desc("direct"), "id")


# --- renames -----------------------------------------------------------------------------------


def rename_status(target: DataFrame, to: str, symbol: DataFrame) -> DataFrame:
    """id, status: ok, invalid_name or occupied (by a name of the same file)."""
    named = target.select("id").join(symbol, "id")
    taken = symbol.where(F.col("name") == to).select("file_path").distinct().withColumn("taken", F.lit(True))
    bad = ~F.lit(to).rlike(IDENTIFIER) | (F.col("name") == to)
    return named.join(taken, "file_path", "left").select("id", F.when(bad, "invalid_name").when(F.col("taken"), "occupied").otherwise("ok").alias("status"))


def _columns(text: Column, name: Column) -> Column:
    """1-based columns at which a name stands as a whole word: gaps between splits, added up."""
    edge = F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_$])"))
    gaps = F.split(text, edge)
    sums = F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, g: F.struct((a["at"] + F.length(g) + F.length(name)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(g))).alias("out")))
    return sums["out"]


def plan_rename(target: DataFrame, symbol: DataFrame, calls: DataFrame, inherits: DataFrame, line: DataFrame, *, include_tests: bool = False) -> DataFrame:
    """target, file_path, line, column, via, confidence: one edit per place the graph knows, the surest if known twice."""
    t = target.select(F.col("id").alias("target")).join(symbol.select(F.col("id").alias("target"), "name", F.col("file_path").alias("own_file"), F.col("start_line").alias("own_line")), "target")
    where = symbol.select(F.col("id").alias("src"), "file_path", "start_line")
    decl = t.select("target", "name", F.col("own_file").alias("file_path"), F.col("own_line").alias("line"), F.lit("declaration").alias("via"), F.lit(1.0).alias("confidence"))
    call = t.join(calls.select("src", F.col("dst").alias("target"), F.col("line").alias("at"), confidence_value(F.col("confidence")).alias("confidence")), "target").join(where, "src").select("target", "name", "file_path", F.when(F.col("at") > 0, F.col("at")).otherwise(F.col("start_line")).alias("line"), F.lit("call").alias("via"), "confidence")
    heir = t.join(inherits.select("src", F.col("dst").alias("target"), confidence_value(F.col("confidence")).alias("confidence")), "target").join(where, "src").select("target", "name", "file_path", F.col("start_line").alias("line"), F.lit("inherits").alias("via"), "confidence")
    others = call.unionByName(heir)
    sites = decl.unionByName(others if include_tests else others.where(~is_test_path(F.col("file_path"))))
    placed = sites.join(line, ["file_path", "line"]).select("target", "file_path", "line", "via", "confidence", F.explode(_columns(F.col("text"), F.col("name"))).alias("column"))
    return placed.groupBy("target", "file_path", "line", "column").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "via")).alias("b")).select("target", "file_path", "line", "column", F.col("b.via").alias("via"), (-F.col("b.less")).alias("confidence"))


def rename_text_only(target: DataFrame, symbol: DataFrame, line: DataFrame, edits: DataFrame) -> DataFrame:
    """target, file_path, line, column, reason: other whole-word occurrences, reported and never changed."""
    t = target.select(F.col("id").alias("target")).join(symbol.select(F.col("id").alias("target"), "name"), "target")
    rivals = t.join(symbol.select("name", F.col("id").alias("other"), "file_path"), "name").where("other <> target").select("target", "file_path", F.lit(True).alias("rival")).distinct()
    words = line.withColumn("name", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_$]+"))))
    found = words.join(t, "name").select("target", "file_path", "line", "text", F.explode(_columns(F.col("text"), F.col("name"))).alias("column"))
    rest = found.join(edits.select("target", "file_path", "line", "column"), ["target", "file_path", "line", "column"], "left_anti").join(rivals, ["target", "file_path"], "left")
    before = F.expr("substring(text, 1, column - 1)")
    quoted = (F.regexp_count(before, F.lit("['\"`]")) % 2) == 1
    remark = F.trim("text").rlike(r"^(//|#|\*|/\*|--)") | before.contains("//") | before.contains("# ")
    reason = F.when(F.col("rival"), "another declaration of this name").when(remark | quoted, "comment or string").otherwise("not in the graph")
    return rest.select("target", "file_path", "line", "column", reason.alias("reason"))


def apply_rename(edits: DataFrame, symbol: DataFrame, line: DataFrame, to: str) -> DataFrame:
    """file_path, line, text of the changed lines, edits from the right so that columns stay true; a line that no longer has the name is refused."""
    name = symbol.select(F.col("id").alias("target"), "name")
    per = edits.join(name, "target").groupBy("file_path", "line", "name").agg(F.sort_array(F.collect_set("column"), asc=False).alias("columns"))
    one = per.join(line, ["file_path", "line"])
    held = F.forall("columns", lambda c: F.substring(F.col("text"), c, F.length("name")) == F.col("name"))
    new = F.aggregate("columns", F.col("text"), lambda t, c: F.concat(F.substring(t, F.lit(1), c - 1), F.lit(to), F.substring(t, c + F.length("name"), F.length(t))))
    told = one.select("file_path", "line", F.col("text").alias("old"), new.alias("new"), held.alias("applied"))
    return told.select("file_path", "line", F.when(F.col("applied"), F.col("new")).otherwise(F.col("old")).alias("text"), "applied")


# --- checks ------------------------------------------------------------------------------------


def import_cycles(imports: DataFrame) -> DataFrame:
    """component, files: sets of files that import each other, and files that import themselves; largest first."""
    parts = strong_components(imports)
    return parts.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("files")).orderBy(F.desc(F.size("files")), F.col("files")[0])


def check(symbol: DataFrame, calls: DataFrame, inherits: DataFrame, imports: DataFrame, about: DataFrame | None = None, include_tests: bool = False) -> DataFrame:
    """kind, severity, subject: cycles, isolated declarations, and files that only import."""
    rows = symbol if include_tests else symbol.where(~is_test_path(F.col("file_path")))
    loops = import_cycles(imports).select(F.lit("cycle").alias("kind"), F.lit("warning").alias("severity"), F.array_join("files", ", ").alias("subject"))
    callable_rows = rows.where(~F.col("kind").rlike(TYPE_KIND)).select("id")
    alone = without_links(callable_rows, calls.select("src", "dst"), inherits.select("src", "dst")).select(F.lit("isolated").alias("kind"), F.lit("info").alias("severity"), F.col("id").alias("subject"))
    bare = imports.select(F.col("src").alias("file_path")).distinct().join(symbol.select("file_path").distinct(), "file_path", "left_anti").where(F.lit(include_tests) | ~is_test_path(F.col("file_path")))
    return loops.unionByName(alone).unionByName(bare.select(F.lit("only imports").alias("kind"), F.lit("info").alias("severity"), F.col("file_path").alias("subject")))


def code_clusters(symbol: DataFrame, calls: DataFrame, inherits: DataFrame, *, min_size: int = 3, members: int = 5, include_tests: bool = False) -> DataFrame:
    """community, size, name (its most frequent folder), members (the best connected)."""
    rows = (symbol if include_tests else symbol.where(~is_test_path(F.col("file_path")))).hint("merge")
    links = calls.select("src", "dst").union(inherits.select("src", "dst")).union(containment(symbol).select(F.col("parent"), F.col("child")))
    ids = rows.select("id")
    inside = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = keep(communities(inside).join(rows.select(F.col("id").alias("node"), "file_path"), "node").join(degrees(calls, inherits).withColumnRenamed("id", "node").hint("merge"), "node", "left"), "clusters")
    size = found.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= max(2, min_size))
    folder = top(found.groupBy("community", directory_of(F.col("file_path")).alias("name")).agg(F.count("*").alias("n")), "community", 1, F.desc("n"), F.asc("name")).select("community", "name")
    lead = top(found.select("community", "node", F.coalesce("degree", F.lit(0)).alias("degree")), "community", members, F.desc("degree"), F.asc("node")).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("members"))
    return size.join(folder, "community").join(lead, "community")


def symbol_map(symbol: DataFrame, calls: DataFrame, inherits: DataFrame, about: DataFrame) -> DataFrame:
    """id, file_path, kind, calls, called_by, bases, memories."""
    gather = lambda df, key, value, name: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias(name))
    out = symbol.select("id", "file_path", "kind")
    for part in (gather(calls, "src", "dst", "calls"), gather(calls, "dst", "src", "called_by"), gather(inherits, "src", "dst", "bases"), gather(about, "symbol_id", "memory_id", "memories")):
        out = out.join(part, "id", "left")
    empty = F.array().cast("array<string>")
    return out.select("id", "file_path", "kind", *[F.coalesce(c, empty).alias(c) for c in ("calls", "called_by", "bases", "memories")])


def crossing_counts(symbol: DataFrame, calls: DataFrame) -> DataFrame:
    """from_module, to_module, calls: how often code of one module calls into another."""
    module = symbol.select("id", module_of(F.col("file_path")).alias("module"))
    both = calls.join(module.withColumnRenamed("id", "src").withColumnRenamed("module", "from_module"), "src").join(module.withColumnRenamed("id", "dst").withColumnRenamed("module", "to_module"), "dst")
    return both.where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("calls"))
