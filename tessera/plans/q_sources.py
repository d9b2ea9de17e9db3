"""Queries: files, projects, histories, and code read from generated sources."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.paths import parameters_of
from tessera.graph.structure import communities, modularity
from tessera.model import dimensions
from tessera.operators import code, memory, reports, surface
from tessera.plans.catalogue import CODE_SQL, code_graph, levels_sql, query
from tessera.plans.ingest import ingest, ingest_into
from tessera.plans.q_code import MARK_SQL
from tessera.plans.q_graph import _links, _memory
from tessera.plans.store import Conflict, Store, capabilities, write_json
from tessera.session import keep, replace_text, shared_dir, table
from tessera.sources import files as fs
from tessera.sources.extract import chunks_of, dense_files, dependences, language_of, symbols_of


def _folder(spark, name):
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


# --- files -------------------------------------------------------------------------------------

TREE = {
    "src/a.py": None, "src/__init__.py": None, "src/_util.py": None, "_top.md": None, ".github/ci.yml": None, ".npmrc": "secret or lock", ".idea/w.xml": "skipped folder", "node_modules/x.js": "skipped folder",
    "logs/x.txt": "ignored", "b/y.tmp": "ignored", "b/keep.tmp": None, "doc/a.svg": "only when named", "doc/b.svg": None, "img/a.PNG": "binary", "a/Cargo.lock": "secret or lock", "zero.dat": "not text",
}
RULES = "# rules\nlogs/\n*.tmp\n!keep.tmp\n"


@query(
    "WITH n AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 1), t(path, reason) AS (VALUES " + ", ".join(f"('{p}', {repr(r) if r else 'NULL'})" for p, r in TREE.items()) + ") SELECT 'n' || n || '/' || path AS path, reason, CASE WHEN reason IS NULL THEN CAST(length('x = ' || n) AS INT) END AS chars FROM n, t"
)
def walk_tree(spark, sf_dir):
    """A real tree in the shared folder, one part for each nation of a region."""
    root = _folder(spark, "tree")
    keys = [r[0] for r in table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey").collect()]
    for n in keys:
        for path in TREE:
            replace_text(spark, f"{root}/n{n}/{path}", "a\0b" if path == "zero.dat" else f"x = {n}")
    found = fs.walk(spark, root, fs.ignore_patterns(RULES), [f"n{n}/doc/b.svg" for n in keys])
    return found.select("path", "reason", F.length(F.col("content").cast("string")).alias("chars"))


@query("SELECT 'n' || n_nationkey AS target, n_regionkey = 1 AS found FROM nation")
def resolved_paths(spark, sf_dir):
    """Targets under a root; an unknown one is an error that names both places tried."""
    root, out = _folder(spark, "targets"), []
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    for r in rows:
        if r.n_regionkey == 1:
            replace_text(spark, f"{root}/n{r.n_nationkey}", "x")
    for r in rows:
        name = f"n{r.n_nationkey}"
        try:
            out.append((name, fs.resolve_target(spark, root, name) == f"{root}/{name}"))
        except FileNotFoundError as e:
            assert root in str(e) and name in str(e)
            out.append((name, False))
    return spark.createDataFrame(out, "target string, found boolean")


@query("SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE lang IN ('en', 'fr')")
def changed_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.concat_ws("/", "source", "lang").alias("path"))
    return fs.changed_list(d.where("lang = 'en'"), d.where("lang = 'fr'"))


@query("WITH r AS (SELECT l_partkey AS file, l_suppkey AS author, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_suppkey) AS n FROM lineitem) SELECT file, author, count(*) AS commits FROM r WHERE n <= 10 GROUP BY 1, 2")
def commit_history(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"), F.col("l_shipdate").alias("at"))
    return fs.commit_history(log, 10)


@query("SELECT n_nationkey || '/a' AS query_id, 'what of ' || n_name AS text, n_name AS expect FROM nation UNION ALL SELECT n_nationkey || '/b', 'and ' || n_regionkey, n_name FROM nation WHERE n_regionkey > 1")
def eval_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    path = _folder(spark, "questions") + "/set.json"
    write_json(spark, path, {"questions": [{"id": str(r.n_nationkey), "kind": "k", "ask": f"what of {r.n_name}", "also": f"and {r.n_regionkey}" if r.n_regionkey > 1 else None, "expect": [r.n_name]} for r in rows]})
    return fs.phrasings(fs.read_questions(spark, path)).select("query_id", "text", F.col("expect")[0].alias("expect"))


@query(r"""WITH q AS (SELECT DISTINCT trim(unnest(regexp_extract_all(replace(text, ',', '?'), '([^.!?\n]+\?)', 1))) AS question FROM conversations WHERE role = 'user') SELECT question FROM q WHERE length(question) BETWEEN 12 AND 300""")
def harvested_questions(spark, sf_dir):
    return fs.harvest_questions(table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", ",", "?")))


@query("SELECT n_name AS name, n_regionkey AS region FROM nation")
def json_sidecar(spark, sf_dir):
    """Written twice; a reader finds the second whole."""
    path = _folder(spark, "sidecar") + "/state.json"
    rows = [{"name": r.n_name, "region": r.n_regionkey} for r in table(spark, sf_dir, "nation").collect()]
    for part in (rows[:1], rows):
        write_json(spark, path, part)
    return fs.read_json_array(spark, path, "name string, region int")


PROJECT_SQL = """p AS (SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 4 THEN 'unknown' WHEN n_nationkey % 3 = 0 THEN 'stale' ELSE 'fresh' END AS freshness, n_nationkey, n_regionkey FROM nation)"""


def _projects(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("name", F.col("n_name"))
    registry = n.select("name", F.concat(F.lit("/r/"), "n_nationkey").alias("root"), F.concat(F.lit("h"), "n_nationkey").alias("commit"))
    heads = n.where("n_nationkey % 5 <> 4").select("name", F.concat(F.lit("h"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("new")).otherwise(F.col("n_nationkey").cast("string"))).alias("head"))
    groups = n.groupBy(F.concat(F.lit("g"), "n_regionkey").alias("name")).agg(F.array_sort(F.collect_set("n_name")).alias("members"))
    return registry, heads, groups


@query(f"WITH {PROJECT_SQL} SELECT name, '/r/' || n_nationkey AS root, freshness, CASE WHEN n_regionkey = 2 THEN 'g2 mine' ELSE 'g' || n_regionkey END AS groups FROM p WHERE n_regionkey <> 3")
def list_projects(spark, sf_dir):
    """After a registration, a group made anew, and projects of one region unregistered."""
    registry, heads, groups = _projects(spark, sf_dir)
    registry = fs.register(registry.withColumn("root", F.lit("old")), registry)
    two = [r.name for r in table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("name")).collect()]
    groups, unknown = fs.set_group(groups, registry, "mine", [*two, "nowhere"])
    assert unknown == ["nowhere"]
    registry, groups = fs.unregister(registry, groups, table(spark, sf_dir, "nation").where("n_regionkey = 3").select(F.col("n_name").alias("name")))
    return fs.list_projects(registry, heads, groups).withColumn("groups", F.array_join("groups", " "))


@query("SELECT lang AS project, source, count(*) AS n FROM documents GROUP BY 1, 2")
def project_map(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("lang", "project")
    names = [r.project for r in d.select("project").distinct().orderBy("project").collect()]
    return fs.per_project(d, lambda rows: rows.groupBy("source").agg(F.count("*").alias("n")), names).select("project", "source", "n")


@query("SELECT * FROM (VALUES ('atomic replace'), ('write lock'), ('tables'), ('python workers'), ('recursive SQL')) t(feature), (SELECT 'ok' AS status) x")
def store_capabilities(spark, sf_dir):
    found = capabilities(spark, _folder(spark, "probe"))
    return spark.createDataFrame([(k, v["status"]) for k, v in found.items()], "feature string, status string")


@query("SELECT n_regionkey AS region, count(*) AS n, 2 AS write_seq, true AS refused FROM nation GROUP BY 1")
def store_conflict(spark, sf_dir):
    """Two writers begin from one snapshot: the second is refused and nothing of the first is lost."""
    store = Store(spark, _folder(spark, "store"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    since = store.commit({"memory": n.limit(1)})
    store.commit({"memory": n}, since=since)
    try:
        store.commit({"memory": n.limit(2)}, since=since)
        refused = False
    except Conflict:
        refused = True
    return store.read("memory").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.lit(store.meta()["write_seq"]).alias("write_seq"), F.lit(refused).alias("refused"))


@query(r"""WITH w AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN '000' || p_partkey WHEN 2 THEN p_partkey || '00' WHEN 3 THEN p_partkey || 'x' WHEN 4 THEN '-' || p_partkey ELSE p_partkey || ' ' END AS text FROM part)
SELECT k, text, CASE WHEN regexp_full_match(text, '[0-9]+') AND try_cast(text AS BIGINT) BETWEEN 8 AND 8192 THEN try_cast(text AS INTEGER) END AS width FROM w""")
def vector_widths(spark, sf_dir):
    """Widths as people write them, a row for each part."""
    k = F.col("p_partkey").cast("string")
    shape = F.col("p_partkey") % 6
    text = F.when(shape == 0, k).when(shape == 1, F.concat(F.lit("000"), k)).when(shape == 2, F.concat(k, F.lit("00"))).when(shape == 3, F.concat(k, F.lit("x"))).when(shape == 4, F.concat(F.lit("-"), k)).otherwise(F.concat(k, F.lit(" ")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.alias("text")).select("k", "text", dimensions(F.col("text")).alias("width"))


@query("SELECT page_id, 'a' || page_id || ' c b' || page_id AS names FROM pages")
def route_parameters(spark, sf_dir):
    path = F.concat(F.lit("/x/:a"), "page_id", F.lit("/{b"), "page_id", F.lit("}/<int:c>/:a"), "page_id")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(parameters_of(path), " ").alias("names"))


@query("SELECT l_suppkey AS path, count(*) AS chunks FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1 HAVING count(*) >= 500")
def dense_reads(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"))
    size = F.when(F.col("path") % 2 == 0, F.col("n") * 100).otherwise(F.col("n") * 500).cast("int")
    held = chunks.groupBy("path").agg(F.count("*").alias("n")).select("path", F.repeat(F.lit("x"), size).alias("text"))
    return dense_files(chunks, held).select("path", "chunks")


EXTENSIONS = (("py", "python"), ("ts", "typescript"), ("java", "java"), ("go", "go"), ("cs", "csharp"), ("vue", "vue"), ("rs", "rust"), ("zzz", "unknown"))


@query("WITH e(i, ext, language) AS (VALUES " + ", ".join(f"({i}, '{e}', '{n}')" for i, (e, n) in enumerate(EXTENSIONS)) + ") SELECT 'd' || doc_id || '.' || ext AS path, language FROM documents JOIN e ON i = doc_id % 8")
def languages_of(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e.upper() if i == 1 else e) for i, (e, _) in enumerate(EXTENSIONS)]), (F.col("doc_id") % 8 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit("."), ext).alias("path"))
    return d.select(F.regexp_replace("path", "TS$", "ts").alias("path"), language_of(F.col("path")).alias("language"))


# --- generated sources: one type for each supplier, in one of five languages; each calls the one of half its number ---------

TEXTS = (
    "class C{k}(C{h}):\n    def run{k}(self):\n        return run{h}(1)\n",
    "import {{ x }} from './lib'\nexport class C{k} extends C{h} {{\n  run{k}(n: number) {{\n    // ghost{k}()\n    return run{h}(1)\n  }}\n}}\n",
    "public class C{k} extends C{h} {{\n  public int run{k}(int n) {{\n    return run{h}(n) + 'x(';\n  }}\n}}\n",
    "package p\ntype C{k} struct {{\n}}\nfunc run{k}(n int) int {{\n  return run{h}(n)\n}}\n",
    "public class C{k} : C{h} {{\n  public int Run{k}(int n) {{\n    return 0;\n  }}\n  public int run{k}(int n) {{\n    return run{h}(n);\n  }}\n}}\n",
)
SUFFIX = ("py", "ts", "java", "go", "cs")
GENERATED_SQL = """ext(i, e) AS (VALUES (0, 'py'), (1, 'ts'), (2, 'java'), (3, 'go'), (4, 'cs')), s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey + 100000 ELSE s_suppkey // 2 END AS h FROM supplier),
f AS (SELECT k, h, 'm' || (k % 3) || '/c' || k || '.' || e AS path, e FROM s JOIN ext ON i = k % 5), d AS (SELECT *, 'Symbol:' || path || ':C' || k AS type, 'Symbol:' || path || ':' || CASE WHEN e = 'go' THEN '' ELSE 'C' || k || '.' END || 'run' || k AS run FROM f)"""


def _generated(spark, sf_dir, change=None):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 10 == 9, F.col("s_suppkey") + 100000).otherwise(F.floor(F.col("s_suppkey") / 2)).alias("h"))
    text, ext = F.lit(None), F.lit(None)
    for i, t in enumerate(TEXTS):
        now = F.lit(t.replace("{{", "{").replace("}}", "}"))
        for name in ("k", "h"):
            now = F.replace(now, F.lit("{" + name + "}"), F.col(name).cast("string"))
        text, ext = F.when(F.col("k") % 5 == i, now).otherwise(text), F.when(F.col("k") % 5 == i, F.lit(SUFFIX[i])).otherwise(ext)
    path = F.concat(F.lit("m"), (F.col("k") % 3).cast("string"), F.lit("/c"), "k", F.lit("."), ext)
    return s.select("k", path.alias("path"), text.alias("text"))


@query(f"""WITH {GENERATED_SQL} SELECT 'call' AS relation, a.run AS src, b.run AS dst, 'unique' AS confidence FROM d a JOIN d b ON b.k = a.h WHERE a.k <> b.k
UNION ALL SELECT 'base', a.type, b.type, 'unique' FROM d a JOIN d b ON b.k = a.h WHERE a.e <> 'go' AND a.k <> b.k UNION ALL SELECT 'pending', run, 'run' || h, 'external' FROM d WHERE h > 100000""")
def ingest_calls(spark, sf_dir):
    """Calls, bases and what stays open, of sources in five languages."""
    got = ingest(_generated(spark, sf_dir), 1)
    pending = got.pending_call.select(F.lit("pending").alias("relation"), F.col("from_symbol").alias("src"), F.col("name").alias("dst"), F.col("reason").alias("confidence"))
    return got.calls.select(F.lit("call").alias("relation"), "src", "dst", "confidence").unionByName(got.inherits.select(F.lit("base").alias("relation"), "src", "dst", "confidence")).unionByName(pending)


@query(f"""WITH {GENERATED_SQL}, c AS (SELECT count(*) AS n FROM d a JOIN d b ON b.k = a.h WHERE a.k <> b.k), o AS (SELECT count(*) AS n FROM d WHERE h > 100000), w AS (SELECT count(*) AS n FROM d)
SELECT 'calls by unique' AS metric, n AS value FROM c UNION ALL SELECT 'pending external', n FROM o UNION ALL SELECT 'resolve rate', 100 UNION ALL SELECT 'chunks whole', n FROM w UNION ALL SELECT 'files without declarations', 0 UNION ALL SELECT 'decision candidates', 0""")
def ingest_report(spark, sf_dir):
    return ingest(_generated(spark, sf_dir), 1).report


@query(f"""WITH {GENERATED_SQL}, now AS (SELECT *, k % 7 = 3 AS changed FROM d WHERE k % 11 <> 5) SELECT a.run AS src, b.run AS dst FROM now a JOIN now b ON b.k = a.h WHERE a.k <> b.k AND NOT a.changed
UNION ALL SELECT a.run, b.run FROM now a JOIN now b ON b.k = a.k // 3 WHERE a.changed AND a.k <> b.k""")
def ingest_increment(spark, sf_dir):
    """Three readings: some files change whom they call, some vanish, one that was missing comes; only these are parsed."""
    store = Store(spark, _folder(spark, "store"))
    whole = _generated(spark, sf_dir)
    ingest_into(store, whole.where("k % 13 <> 4").select("path", "text"), 1)
    third = F.regexp_replace("text", r"run[0-9]+\((n|1)\)", F.concat(F.lit("run"), F.floor(F.col("k") / 3).cast("string"), F.lit("($1)")))
    kept = whole.where("k % 11 <> 5").withColumn("text", F.when(F.col("k") % 7 == 3, third).otherwise(F.col("text")))
    ingest_into(store, kept.where("k % 13 <> 4").select("path", "text"), 2)
    ingest_into(store, kept.select("path", "text"), 3)
    assert ingest_into(store, kept.select("path", "text"), 4) == 3  # nothing changed, nothing written
    return store.read("calls").select("src", "dst")


COMPONENT = "<template>\n" + "<p>row of the template</p>\n" * 60 + "</template>\n<script>\nfunction go{k}() {\n  return call(1)\n}\n</script>\n<style>\np { color: red }\n</style>\n"


@query("SELECT 'c' || s_suppkey || '.vue' AS path, h AS heading, a AS first, b AS last FROM supplier, (VALUES ('template', 1, 23), ('template', 20, 43), ('template', 39, 62), ('script', 63, 67), ('style', 68, 70)) t(h, a, b) WHERE h <> 'template' UNION ALL SELECT 'go' || s_suppkey, 'function', 64, 66 FROM supplier")
def component_chunks(spark, sf_dir):
    """Blocks of single-file components as chunks (those of the script and the style), and what the script declares."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), "s_suppkey", F.lit(".vue")).alias("path"), F.replace(F.lit(COMPONENT), F.lit("{k}"), F.col("s_suppkey").cast("string")).alias("text"))
    chunks = chunks_of(s).select("path", F.col("headings")[0].alias("heading"), "first", "last").where("heading <> 'template'")
    return chunks.unionByName(symbols_of(s).select(F.col("name").alias("path"), F.col("kind").alias("heading"), F.col("start_line").alias("first"), F.col("end_line").alias("last")))


STATEMENTS = "function f{k}(n) {\n  let a = n + {k}\n  if (a > 1) {\n    a = g(a, b)\n  }\n  return a\n}\n"


@query("SELECT s_suppkey AS k, t.* FROM supplier, (VALUES (2, 'a', 'n', NULL), (3, '', 'a', NULL), (4, 'a', 'a b', 3), (6, '', 'a', NULL)) t(line, defines, uses, controlled_by)")
def statement_dependences(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")

    def run(batches):
        for batch in batches:
            rows = [(k, d["line"], " ".join(d["defines"]), " ".join(d["uses"]), d["controlled_by"]) for k in batch["s_suppkey"] for d in dependences("a.ts", STATEMENTS.replace("{k}", str(k)), 2, 6)]
            yield pd.DataFrame(rows, columns=["k", "line", "defines", "uses", "controlled_by"]).astype({"controlled_by": "Int64"})

    return keys.mapInPandas(run, "k long, line int, defines string, uses string, controlled_by int")


def _lines(spark, sf_dir):
    """Files f{k}.ts of four lines: a declaration, a call, an end, a remark."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 2).alias("h"))
    texts = F.array(F.concat(F.lit("function fn"), "k", F.lit("(x) {")), F.concat(F.lit("  fn"), "h", F.lit("(x); fn"), "h", F.lit("(1)")), F.lit("}"), F.concat(F.lit("// fn"), "h", F.lit(" is old")))
    line = s.select(F.concat(F.lit("f"), "k", F.lit(".ts")).alias("file_path"), F.posexplode(texts).alias("n", "text")).select("file_path", (F.col("n") + 1).alias("line"), "text")
    symbol = s.select(F.concat(F.lit("Symbol:f"), "k", F.lit(".ts:fn"), "k").alias("id"), F.concat(F.lit("fn"), "k").alias("name"), F.concat(F.lit("f"), "k", F.lit(".ts")).alias("file_path"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"), "k")
    calls = s.where("h > 0").select(F.concat(F.lit("Symbol:f"), "k", F.lit(".ts:fn"), "k").alias("src"), F.concat(F.lit("Symbol:f"), "h", F.lit(".ts:fn"), "h").alias("dst"), F.concat(F.lit("fn"), "h").alias("name"), F.lit(2).alias("line"), F.lit("type").alias("confidence"))
    return line, symbol, calls, spark.createDataFrame([], "src string, dst string, confidence string")


RENAME_SQL = "s AS (SELECT s_suppkey AS k, s_suppkey // 2 AS h FROM supplier), t AS (SELECT k AS t FROM s WHERE k % 4 = 3)"


@query(f"""WITH {RENAME_SQL} SELECT 'fn' || t AS name, 'f' || t || '.ts' AS file_path, 1 AS line, 10 AS "column", 'declaration' AS via FROM t
UNION ALL SELECT 'fn' || t, 'f' || k || '.ts', 2, c, 'call' FROM t JOIN s ON h = t, (VALUES (0), (1)) x(i), LATERAL (SELECT CASE i WHEN 0 THEN 3 ELSE 10 + length('' || t) END AS c) y""")
def rename_plan(spark, sf_dir):
    line, symbol, calls, inherits = _lines(spark, sf_dir)
    plan = code.plan_rename(symbol.where("k % 4 = 3").select("id"), symbol.drop("k"), calls, inherits, line)
    return plan.select(F.regexp_replace("target", "^.*:", "").alias("name"), "file_path", "line", "column", "via")


@query(f"WITH {RENAME_SQL} SELECT 'f' || t || '.ts' AS file_path, 1 AS line, 'function new(x) {{' AS text, true AS applied FROM t UNION ALL SELECT 'f' || k || '.ts', 2, '  new(x); new(1)', true FROM t JOIN s ON h = t")
def rename_applied(spark, sf_dir):
    line, symbol, calls, inherits = _lines(spark, sf_dir)
    plan = code.plan_rename(symbol.where("k % 4 = 3").select("id"), symbol.drop("k"), calls, inherits, line)
    return code.apply_rename(plan, symbol.select("id", "name"), line, "new")


@query(f"""WITH {RENAME_SQL} SELECT 'fn' || t AS name, 'f' || k || '.ts' AS file_path, 4 AS line, 4 AS "column", 'comment or string' AS reason FROM t JOIN s ON h = t""")
def rename_leftovers(spark, sf_dir):
    line, symbol, calls, inherits = _lines(spark, sf_dir)
    target = symbol.where("k % 4 = 3").select("id")
    plan = code.plan_rename(target, symbol.drop("k"), calls, inherits, line)
    return code.rename_text_only(target, symbol.drop("k"), line, plan).select(F.regexp_replace("target", "^.*:", "").alias("name"), "file_path", "line", "column", "reason")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT 'duplicate' AS kind, '/s/:id' || (k // 2) AS path, 'r' || k || '.ts' AS file_path FROM s WHERE (k % 2 = 0 AND k + 1 IN (SELECT k FROM s)) OR (k % 2 = 1 AND k - 1 IN (SELECT k FROM s))
UNION ALL SELECT CASE WHEN k % 3 = 1 THEN 'unbound-parameter' ELSE 'no-handler' END, '/s/:id' || (k // 2), 'r' || k || '.ts' FROM s WHERE k % 3 > 0""")
def route_shapes(spark, sf_dir):
    """Routes of files: every third one uses its parameter in a handler, one does not, one has no handler (and speaks of its parameter)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("id"), F.floor(F.col("s_suppkey") / 2).cast("string")).alias("p"), F.concat(F.lit("r"), "s_suppkey", F.lit(".ts")).alias("file_path"))
    first = F.concat(F.lit("app.get('/s/:"), "p", F.lit("', h)"))
    body = F.when(F.col("k") % 3 == 1, F.lit("  go()")).otherwise(F.concat(F.lit("  use("), "p", F.lit(")")))
    line = s.select("file_path", F.posexplode(F.array(first, body, F.lit("}"))).alias("n", "text")).select("file_path", (F.col("n") + 1).alias("line"), "text")
    symbol = s.where("k % 3 < 2").select(F.concat(F.lit("Symbol:"), "file_path", F.lit(":h")).alias("id"), "file_path", F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    return surface.shape_check(surface.route_map(line, symbol), symbol, line).select("kind", "path", "file_path")


@query("SELECT CASE s_suppkey % 3 WHEN 1 THEN 'named' ELSE 'look' END || s_suppkey AS name, 't' || s_suppkey || CASE WHEN s_suppkey % 3 = 2 THEN '.ts' ELSE '.py' END AS file_path, CASE s_suppkey % 3 WHEN 0 THEN 'python-decorator' WHEN 1 THEN 'python-decorator' ELSE 'mcp-sdk-object' END AS style, CASE WHEN s_suppkey % 3 = 2 THEN 'finds ' || s_suppkey END AS description FROM supplier")
def tool_map(spark, sf_dir):
    k = F.col("s_suppkey")
    texts = (
        F.when(k % 3 == 0, F.array(F.lit("@mcp.tool()"), F.concat(F.lit("def look"), k, F.lit("(x):")), F.lit("    pass")))
        .when(k % 3 == 1, F.array(F.concat(F.lit("@server.tool('named"), k, F.lit("')")), F.lit("def other(x):"), F.lit("    pass")))
        .otherwise(F.array(F.lit("{"), F.concat(F.lit("  name: 'look"), k, F.lit("',")), F.concat(F.lit("  description: 'finds "), k, F.lit("',")), F.lit("  inputSchema: {},"), F.lit("}")))
    )
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), k, F.when(k % 3 == 2, ".ts").otherwise(".py")).alias("file_path"), F.posexplode(texts).alias("n", "text"))
    return surface.tool_map(s.select("file_path", (F.col("n") + 1).alias("line"), "text")).select("name", "file_path", "style", "description")


API_SQL = f"""{CODE_SQL}, back AS (SELECT dst AS src, src AS dst, confidence FROM calls UNION ALL SELECT child, parent, 1.0 FROM member), targets AS (SELECT id AS source, id AS node FROM symbol WHERE p % 40 = 1), {levels_sql('back', 'targets', 3)}"""


@query(f"WITH {API_SQL} SELECT source, '/r/' || s.p AS path, CAST(min(depth) AS INT) AS depth FROM found JOIN symbol s ON s.id = node WHERE s.p % 6 = 0 GROUP BY 1, 2")
def api_impact(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    routes = g["symbol"].where("p % 6 = 0").select(F.lit("GET").alias("method"), F.concat(F.lit("/r/"), "p").alias("path"), F.col("id").alias("handler"))
    return surface.api_impact(g["symbol"].where("p % 40 = 1").select("id"), routes, g["symbol"], g["calls"], max_depth=3).select("source", "path", "depth")


@query(f"""WITH {CODE_SQL}, {MARK_SQL}, hop AS (SELECT DISTINCT src, dst, 1.0::DOUBLE AS confidence FROM calls), starts AS (SELECT symbol_id AS source, symbol_id AS node FROM marked WHERE role = 'source'), {levels_sql('hop', 'starts', 2)},
t AS (SELECT f.source AS source_id, f.node AS sink_id, f.depth, f.parent FROM found f JOIN marked a ON a.symbol_id = f.source AND a.role = 'source' JOIN marked b ON b.symbol_id = f.node AND b.role = 'sink')
SELECT source_id AS id, 'source' AS role, source_id, sink_id FROM t UNION ALL SELECT sink_id, 'sink', source_id, sink_id FROM t UNION ALL SELECT parent, 'on the way', source_id, sink_id FROM t WHERE depth = 2""")
def taint_explained(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    s = g["symbol"].where("file_path NOT LIKE 'tests/%' AND (size <= 5 OR size >= 46 OR size = 25)")
    role = F.when(F.col("size") <= 5, "source").when(F.col("size") >= 46, "sink").otherwise("sanitizer")
    marked = s.select(F.col("id").alias("symbol_id"), role.alias("role"), role.alias("marker"), F.col("p").alias("line"))
    return surface.explain(surface.taint_of(marked, g["calls"], max_depth=2), g["symbol"].select("id")).select("id", "role", "source_id", "sink_id")


@query(f"WITH {CODE_SQL}, e AS (SELECT DISTINCT src, dst FROM calls ORDER BY 1, 2 LIMIT 100), q AS (SELECT *, regexp_replace(src, '^.*:', '') AS a, regexp_replace(dst, '^.*:', '') AS b FROM e) SELECT '  n' || left(sha1(src), 8) || '[\"' || a || '\"] --> n' || left(sha1(dst), 8) || '[\"' || b || '\"]' AS line FROM q")
def call_diagram(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return reports.mermaid(g["symbol"], g["calls"])


@query(f"WITH {CODE_SQL} SELECT src, module, CASE WHEN module = 'lost' THEN NULL ELSE dst END AS dst FROM (SELECT src, dst, dst AS module FROM imports UNION ALL SELECT DISTINCT src, src, 'lost' FROM imports) x")
def resolved_imports(spark, sf_dir):
    i = code_graph(spark, sf_dir)["imports"].select("src", "dst")
    asked = i.select("src", F.col("dst").alias("module"), F.regexp_replace("dst", r"\.ts$", "").alias("path")).unionByName(i.select("src", F.lit("lost").alias("module"), F.lit("no/such").alias("path")).distinct())
    return code.resolve_imports(asked, i.select(F.col("src").alias("path")).union(i.select("dst")).distinct())


@query(f"WITH {CODE_SQL}, gone AS (SELECT id FROM symbol WHERE p % 9 = 2) SELECT src, dst, 'kept' AS state FROM calls WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) UNION ALL SELECT src, 'f', 'pending' FROM calls WHERE src NOT IN (SELECT id FROM gone) AND dst IN (SELECT id FROM gone)")
def reopened_calls(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    left, pending = code.reopen_calls(g["calls"], g["symbol"], g["symbol"].where("p % 9 = 2"))
    return left.select("src", "dst", F.lit("kept").alias("state")).unionByName(pending.select(F.col("from_symbol").alias("src"), F.col("name").alias("dst"), F.lit("pending").alias("state")))


# --- communities: what must hold of any good answer ---------------------------------------------


@query(f"WITH {CODE_SQL}, k AS (SELECT id, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM symbol WHERE NOT is_test) SELECT count(*) AS folders, true AS named_by_folder, true AS within_size, true AS once FROM (SELECT DISTINCT folder FROM k) x")
def code_clusters(spark, sf_dir):
    """Every cluster is named by a folder that exists, has at least three members, and no declaration leads two."""
    g = code_graph(spark, sf_dir)
    found = keep(code.code_clusters(g["symbol"], g["calls"], g["inherits"]), "clusters")
    folders = g["symbol"].where("file_path NOT LIKE 'tests/%'").select(F.regexp_replace("file_path", "/[^/]*$", "").alias("name")).distinct()
    lost = found.join(folders, "name", "left_anti").count()
    told = found.agg(F.min("size").alias("least"), F.sum(F.size("members")).alias("n")).first()
    one = found.select(F.explode("members").alias("m")).distinct().count()
    return folders.agg(F.count("*").alias("folders"), F.lit(lost == 0).alias("named_by_folder"), F.lit(told.least >= 3).alias("within_size"), F.lit(one == told.n).alias("once"))


@query("SELECT true AS members_live, true AS positive, true AS named_terms")
def memory_clusters(spark, sf_dir):
    rows, links = _memory(spark, sf_dir), _links(spark, sf_dir)
    own = keep(communities(links.select("src", "dst", "weight")), "communities")
    found = keep(memory.clusters(rows, links, found=own), "clusters")
    lead = found.select(F.explode("representatives").alias("id"))
    good = modularity(links.select("src", "dst"), own) > 0.3
    return found.agg(F.lit(lead.join(rows, "id", "left_anti").isEmpty()).alias("members_live"), F.lit(good).alias("positive"), (F.count("*") > 0).alias("named_terms"))
