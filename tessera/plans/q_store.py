"""Queries: the store, the journal stream, incremental reading, sinks and ad-hoc SQL."""

import json
import uuid

from pyspark.sql import functions as F

from tessera.functions.paths import canonical_path, is_test_path, module_of, normalise_path
from tessera.model import MEMORY, MEMORY_EDGE
from tessera.operators import reports
from tessera.operators.memory import add_edges
from tessera.operators.sqlguard import read_only_sql
from tessera.plans.catalogue import query
from tessera.plans.store import Store, merge_journal, upsert
from tessera.session import shared_dir, table
from tessera.sources.files import changed_files, stamps, vanished
from tessera.streaming.journal import bad_lines, merge_stream, read_journal_stream, waiting_edges


def _nodes(df, layer):
    given = {"id": F.concat(F.lit("d"), "doc_id"), "layer": F.lit(layer), "title": F.col("source"), "body": F.col("text"), "source_ref": F.col("source"), "importance": (F.col("doc_id") % 7).cast("double"), "created_at": F.col("doc_id"), "access_count": F.lit(0), "last_seen_at": F.lit(1)}
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MEMORY.fields])


@query("""SELECT 'd' || doc_id AS id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS access_count, CASE WHEN lang = 'en' THEN 99 ELSE 1 END AS last_seen_at, CASE WHEN lang = 'en' THEN greatest(doc_id % 7, 5) ELSE doc_id % 7 END::DOUBLE AS importance FROM documents WHERE lang IN ('en', 'fr', 'de')""")
def upsert_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known, delta = _nodes(docs.where("lang IN ('en', 'fr')"), "artifact"), docs.where("lang IN ('en', 'de')")
    raised = _nodes(delta.where("lang = 'en'"), "artifact").withColumn("importance", F.greatest("importance", F.lit(5.0)))
    out = upsert(known, raised.unionByName(_nodes(delta.where("lang = 'de'"), "artifact")), 99)
    return out.select("id", F.col("access_count").cast("int").alias("access_count"), F.col("last_seen_at").cast("int").alias("last_seen_at"), "importance")


@query("SELECT doc_id, CASE lang WHEN 'es' THEN 'changed' ELSE 'new' END AS state FROM documents WHERE lang IN ('es', 'fr') UNION ALL SELECT -1 - doc_id, 'gone' FROM documents WHERE lang = 'de'")
def incremental_stamps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("f"), "doc_id").alias("path"), F.col("text").alias("content"))
    old = docs.where("lang <> 'fr'").withColumn("content", F.when(F.col("lang") == "es", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    lost = docs.where("lang = 'de'").select(F.concat(F.lit("f"), (-1 - F.col("doc_id")).cast("string")).alias("path"), "content")
    known = stamps(old).unionByName(stamps(lost))
    todo = changed_files(docs, known).select("doc_id", F.when(F.col("lang") == "es", "changed").otherwise("new").alias("state"))
    gone = vanished(known, docs, "f").select(F.regexp_replace("path", "^f", "").cast("long").alias("doc_id"), F.lit("gone").alias("state"))
    return todo.unionByName(gone)


def _journal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    node = F.struct(F.concat(F.lit("u"), "user_id").alias("id"), F.lit("episodic").alias("layer"), F.col("event_type").alias("title"), F.col("props").alias("body"), F.lit("s").alias("source_ref"), F.lit(5.0).alias("importance"), at.alias("created_at"))
    edge = F.struct(F.concat(F.lit("u"), "user_id").alias("src"), F.concat(F.lit("u"), (F.col("event_id") % 300).cast("string")).alias("dst"), F.lit("RESOLVES").alias("type"), F.lit(1.0).alias("weight"))
    is_node = F.col("event_id") % 2 == 0
    return e.select(F.when(is_node, "node").otherwise("edge").alias("kind"), at.alias("at"), F.when(is_node, node).alias("node"), F.when(~is_node, edge).alias("edge"))


JOURNAL_SQL = """e AS (SELECT event_id, 'u' || user_id AS u, 'u' || (event_id % 300) AS d FROM events), n AS (SELECT DISTINCT u AS id FROM e WHERE event_id % 2 = 0), x AS (SELECT DISTINCT u AS src, d AS dst FROM e WHERE event_id % 2 = 1)"""
JOURNAL_COUNTS = f"WITH {JOURNAL_SQL}, ok AS (SELECT * FROM x WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM ok UNION ALL SELECT 'dropped', (SELECT count(*) FROM x) - count(*) FROM ok"


@query(JOURNAL_COUNTS)
def journal_merge(spark, sf_dir):
    memory, edges, dropped = merge_journal(spark.createDataFrame([], MEMORY), spark.createDataFrame([], MEMORY_EDGE), _journal(spark, sf_dir))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(memory, "nodes").unionByName(count(edges, "edges")).unionByName(count(dropped, "dropped"))


@query("SELECT 'node' AS kind, epoch_us(ts::TIMESTAMP) // 1000 AS at, 'u' || user_id AS a, event_type AS b FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'edge', epoch_us(ts::TIMESTAMP) // 1000, 'u' || user_id, 'u' || (event_id % 300) FROM events WHERE event_id % 2 = 1 UNION ALL SELECT NULL, NULL, 'broken ' || event_id, NULL FROM events WHERE event_id % 97 = 0")
def journal_stream(spark, sf_dir):
    """The journal as a stream, run to the end of what is there: each entry, and each line that is none."""
    base = f"{shared_dir(spark)}/tessera/journal-{uuid.uuid4().hex}"
    broken = table(spark, sf_dir, "events").where("event_id % 97 = 0").select(F.concat(F.lit("broken "), "event_id").alias("value"))
    _journal(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).unionByName(broken).write.text(f"{base}/in")
    entries = read_journal_stream(spark, f"{base}/in")
    done = entries.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("kind", "at", F.coalesce("node.id", "edge.src", "bad_line").alias("a"), F.coalesce("node.title", "edge.dst").alias("b"))


@query(f"""WITH {JOURNAL_SQL}, ok AS (SELECT * FROM x WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT 'node' AS what, id AS a, NULL AS b FROM n UNION ALL SELECT 'edge', src, dst FROM ok UNION ALL SELECT 'waiting', src, dst FROM (SELECT * FROM x EXCEPT SELECT * FROM ok) UNION ALL SELECT 'bad', 'broken ' || event_id, NULL FROM events WHERE event_id % 97 = 0""")
def journal_late_nodes(spark, sf_dir):
    """All edges come first, in a batch of their own, and wait for their nodes, which come in two more."""
    base = f"{shared_dir(spark)}/tessera/journal-{uuid.uuid4().hex}"
    store, entries = Store(spark, f"{base}/store"), _journal(spark, sf_dir)
    broken = table(spark, sf_dir, "events").where("event_id % 97 = 0").select(F.concat(F.lit("broken "), "event_id").alias("value"))
    lines = entries.select(F.to_json(F.struct("*")).alias("value"), "kind", (F.col("at") % 2).alias("half"))
    for part in (lines.where("kind = 'edge'").select("value").unionByName(broken), lines.where("kind = 'node' AND half = 0").select("value"), lines.where("kind = 'node' AND half <> 0").select("value")):
        part.write.mode("append").text(f"{base}/in")
        merge_stream(store, f"{base}/in", f"{base}/state")
    none = F.lit(None).cast("string")
    parts = [store.read("memory").select(F.lit("node").alias("what"), F.col("id").alias("a"), none.alias("b")), store.read("memory_edge").select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")), waiting_edges(store).select(F.lit("waiting").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")), bad_lines(store, f"{base}/state").select(F.lit("bad").alias("what"), F.col("line").alias("a"), none.alias("b"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH n AS (SELECT 'c' || o_custkey AS src, 'c' || (o_orderkey % 200) AS dst, CASE WHEN o_orderkey % 7 = 0 THEN 'LIKES' ELSE 'RESOLVES' END AS type FROM orders), ids AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0),
told AS (SELECT *, CASE WHEN type = 'LIKES' THEN 'unknown type LIKES' WHEN src NOT IN (SELECT id FROM ids) THEN 'no node ' || src WHEN dst NOT IN (SELECT id FROM ids) THEN 'no node ' || dst END AS reason FROM n)
SELECT DISTINCT src, dst, type, NULL AS reason FROM told WHERE reason IS NULL UNION ALL SELECT * FROM told WHERE reason IS NOT NULL""")
def edge_checks(spark, sf_dir):
    """Edges from orders, between customers of whom a third are no nodes."""
    o = table(spark, sf_dir, "orders")
    new = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("c"), (F.col("o_orderkey") % 200).cast("string")).alias("dst"), F.when(F.col("o_orderkey") % 7 == 0, "LIKES").otherwise("RESOLVES").alias("type"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("created_at"), F.lit(None).cast("string").alias("evidence_ref"))
    ids = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    ok, bad = add_edges(spark.createDataFrame([], MEMORY_EDGE), new, ids)
    return ok.select("src", "dst", "type", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("src", "dst", "type", "reason"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 100")
def guarded_sql(spark, sf_dir):
    return read_only_sql(spark, "SELECT o_orderpriority, count(*) AS n FROM orders_view GROUP BY 1 ORDER BY 1;", orders_view=table(spark, sf_dir, "orders"))


@query("""WITH a AS (SELECT url AS path, md5(html) AS h FROM pages WHERE url NOT LIKE '%?%'), b AS (SELECT url AS path, md5(html || CASE WHEN url LIKE '%/fr/%' THEN 'x' ELSE '' END) AS h FROM pages WHERE url NOT LIKE '%#%'), x AS (SELECT path, min(h) AS h FROM a GROUP BY 1), y AS (SELECT path, min(h) AS h FROM b GROUP BY 1)
SELECT coalesce(x.path, y.path) AS path, CASE WHEN y.h IS NULL THEN 'missing' WHEN x.h IS NULL THEN 'extra' WHEN x.h <> y.h THEN 'changed' ELSE 'current' END AS state FROM x FULL JOIN y ON x.path = y.path""")
def wiki_drift(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hash_of = lambda c: F.md5(c.cast("binary"))
    a = p.where("url NOT LIKE '%?%'").select(F.col("url").alias("path"), hash_of(F.col("html")).alias("h"))
    b = p.where("url NOT LIKE '%#%'").select(F.col("url").alias("path"), hash_of(F.concat("html", F.when(F.col("url").contains("/fr/"), "x").otherwise(""))).alias("h"))
    least = lambda df, foot: df.groupBy("path").agg(F.concat(F.min("h"), F.lit(foot)).alias("body"))
    return reports.wiki_drift(least(a, "\n<!-- provenance: today -->"), least(b, ""))


@query("""WITH s AS (SELECT conv_id, turn, length('{"conv_id":' || conv_id || ',"turn":' || turn || '}') + 1 AS b, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
c AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bytes FROM s) SELECT conv_id, turn, CAST(bytes AS BIGINT) AS bytes, total - count(*) OVER (PARTITION BY conv_id) AS omitted FROM c WHERE bytes <= 60""")
def budgeted_json(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return reports.budgeted_json(rows, "conv_id", ["turn"], 60).select("conv_id", "turn", "bytes", "omitted")


@query("""WITH d AS (SELECT 'd' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'artifact' ELSE 'semantic' END AS layer, (doc_id % 7)::DOUBLE AS importance, doc_id FROM documents), e AS (SELECT 'd' || doc_id AS src, 'd' || (doc_id // 2) AS dst FROM documents WHERE lang = 'en'),
g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x GROUP BY 1), t AS (SELECT d.*, coalesce(degree, 0) AS degree, CASE WHEN layer <> 'artifact' AND degree > 0 THEN 0 WHEN layer <> 'artifact' THEN 1 WHEN degree > 0 THEN 2 ELSE 3 END AS tier FROM d LEFT JOIN g USING (id)),
r AS (SELECT *, row_number() OVER (ORDER BY tier, degree DESC, importance DESC, id) AS rn FROM t), o AS (SELECT *, sum(CASE WHEN rn > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY tier) AS omitted FROM r) SELECT id, CAST(tier AS INT) AS tier, degree, CAST(omitted AS BIGINT) AS omitted FROM o WHERE rn <= 100""")
def viewer_nodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    layer = F.when(F.col("doc_id") % 3 == 0, "artifact").otherwise("semantic")
    rows = d.select(F.concat(F.lit("d"), "doc_id").alias("id"), layer.alias("layer"), F.col("source").alias("title"), F.col("text").alias("body"), (F.col("doc_id") % 7).cast("double").alias("importance"), F.lit(None).cast("long").alias("superseded_at"))
    edges = d.where("lang = 'en'").select(F.concat(F.lit("d"), "doc_id").alias("src"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2).cast("string")).alias("dst"))
    return reports.viewer_nodes(rows, edges, 100).select("id", "tier", "degree", "omitted")


#: Shapes of paths and routes; # stands for a part's key.
SHAPES = ["src/a/b#.ts", "tests/x#.ts", "a/b#.test.js", "pkg/test_#.py", "x#_test.go", "X#Tests.cs", "a#.ts", "src\\w#\\z.ts", "a//b/./c#/../d/"]
ROUTES = ["/a#/:id/", "/b/{x#}/c", "/d/<int:k#>", "/e#/${v}", "/", "/API/Users#/"]


def _shaped(spark, sf_dir, shapes):
    """A row for each part, in turn of one of the shapes."""
    given = F.element_at(F.array(*map(F.lit, shapes)), (F.col("p_partkey") % len(shapes) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.replace(given, F.lit("#"), F.col("p_partkey").cast("string")).alias("path"))


def _shaped_sql(shapes, *more):
    """The same, with further columns of one value for each shape."""
    pick = lambda values: "CASE " + " ".join(f"WHEN p_partkey % {len(shapes)} = {i} THEN replace('{v}', '#', p_partkey::VARCHAR)" for i, v in enumerate(values)) + " END"
    return f"s AS (SELECT p_partkey AS k, {pick(shapes)} AS path" + "".join(f", {pick(values)} AS {name}" for name, values in more) + " FROM part)"


@query("WITH " + _shaped_sql(SHAPES, ("canonical", [*SHAPES[:7], "src/w#/z.ts", "a/b/d"])) + r""" SELECT k, path, regexp_matches(lower(replace(path, '\', '/')), '(^|/)(tests?|__tests__|spec|specs)/|\.(test|spec)\.[a-z0-9]+$|(^|/)test_[^/]+\.py$|_test\.(go|py|rb|exs?)$|tests?\.cs$') AS is_test,
CASE WHEN path LIKE '%/%' THEN array_to_string(list_slice(string_split(path, '/'), 1, least(2, len(string_split(path, '/')) - 1)), '/') ELSE '(root)' END AS module, canonical FROM s""")
def path_functions(spark, sf_dir):
    c = F.col("path")
    return _shaped(spark, sf_dir, SHAPES).select("k", "path", is_test_path(c).alias("is_test"), module_of(c).alias("module"), canonical_path(c).alias("canonical"))


@query("WITH " + _shaped_sql(ROUTES, ("normal", ["/a#/*", "/b/*/c", "/d/*", "/e#/*", "/", "/api/users#"])) + " SELECT k, path, normal FROM s")
def route_normal_forms(spark, sf_dir):
    return _shaped(spark, sf_dir, ROUTES).select("k", "path", normalise_path(F.col("path")).alias("normal"))


@query("SELECT count(*) AS rows, 2 AS write_seq, true AS same FROM documents")
def snapshot_store(spark, sf_dir):
    """Two commits; the second names the unchanged table again."""
    store = Store(spark, f"{shared_dir(spark)}/tessera/store-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    store.commit({"memory": docs})
    before = store.meta()["tables"]["memory"]
    seq = store.commit({"symbol": docs.limit(1)})
    same = json.dumps(before) == json.dumps(store.meta()["tables"]["memory"])
    return store.read("memory").agg(F.count("*").alias("rows"), F.lit(seq).alias("write_seq"), F.lit(same).alias("same"))
