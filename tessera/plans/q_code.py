"""Queries: the code graph."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import code, surface
from tessera.plans.catalogue import CODE_SQL, code_graph, levels_sql, query, sql_values, values
from tessera.session import shared_dir, table
from tessera.sources.files import lines, read_diff

CRITICAL_SQL = "'auth|login|logout|session|token|password|passwd|credential|permission|role|acl|payment|billing|checkout|invoice|charge|refund|subscription|entitlement|crypto|encrypt|decrypt|secret|signature|security'"
STRONG_SQL = """strong AS (SELECT src, dst, max(confidence) AS confidence FROM (SELECT src, dst, confidence FROM calls UNION ALL SELECT src, dst, confidence FROM inherits) x GROUP BY 1, 2)"""
UP_SQL = f"""{STRONG_SQL}, back AS (SELECT dst AS src, src AS dst, confidence FROM strong), up_all AS (SELECT * FROM back UNION ALL SELECT m.parent, b.dst, b.confidence FROM back b JOIN member m ON m.child = b.src WHERE m.parent <> b.dst),
up AS (SELECT * FROM up_all WHERE dst NOT IN (SELECT id FROM symbol WHERE is_test))"""
DOWN_SQL = f"""{STRONG_SQL}, down_all AS (SELECT * FROM strong UNION ALL SELECT m.parent, b.dst, b.confidence FROM strong b JOIN member m ON m.child = b.src WHERE m.parent <> b.dst),
down AS (SELECT * FROM down_all WHERE dst NOT IN (SELECT id FROM symbol WHERE is_test))"""
LABEL_SQL = "CASE depth WHEN 1 THEN 'WILL BREAK' WHEN 2 THEN 'LIKELY AFFECTED' WHEN 3 THEN 'MAY NEED TESTING' ELSE 'TRANSITIVE' END"
TARGETS_SQL = "targets AS (SELECT id AS source, id AS node FROM symbol WHERE kind = 'class')"


def _targets(g):
    return g["symbol"].where("kind = 'class'").select("id")


@query(f"WITH {CODE_SQL}, {UP_SQL}, {TARGETS_SQL}, {levels_sql('up', 'targets', 3)} SELECT source, node, CAST(depth AS INT) AS depth, round(confidence + 1e-9, 4) AS confidence, parent, {LABEL_SQL} AS label FROM found WHERE depth > 0")
def impact_upstream(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.impact(_targets(g), g["symbol"], g["calls"], g["inherits"]).drop("via")


@query(f"WITH {CODE_SQL}, {DOWN_SQL}, {TARGETS_SQL}, {levels_sql('down', 'targets', 5)} SELECT source, node, CAST(depth AS INT) AS depth, round(confidence + 1e-9, 4) AS confidence, parent, {LABEL_SQL} AS label FROM found WHERE depth > 0")
def impact_downstream(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.impact(_targets(g), g["symbol"], g["calls"], g["inherits"], direction="downstream", max_depth=5).drop("via")


@query(f"""WITH {CODE_SQL}, {UP_SQL}, {TARGETS_SQL}, {levels_sql('up', 'targets', 2)}, c AS (SELECT source, count(*) AS symbols, count_if(depth = 1) AS direct FROM found WHERE depth > 0 GROUP BY 1),
own AS (SELECT s.id AS source, file_path FROM symbol s WHERE kind = 'class'),
g AS (SELECT source, bool_or(regexp_matches(lower(t), {CRITICAL_SQL})) AS critical FROM (SELECT source, regexp_replace(node, '^.*:', '') || ' ' || file_path AS t FROM found JOIN symbol ON id = node WHERE depth = 1 UNION ALL SELECT source, regexp_replace(source, '^.*:', '') || ' ' || file_path FROM own) x GROUP BY 1),
f AS (SELECT source, string_agg(DISTINCT src, ' ' ORDER BY src) AS files FROM own JOIN imports ON dst = file_path WHERE src NOT LIKE 'tests/%' GROUP BY 1),
t AS (SELECT b.dst AS source, count(DISTINCT b.src) AS tests FROM (SELECT src, dst FROM calls UNION ALL SELECT src, dst FROM inherits) b JOIN symbol s ON s.id = b.src WHERE s.is_test GROUP BY 1)
SELECT source, coalesce(symbols, 0) AS symbols, coalesce(direct, 0) AS direct, CASE WHEN critical THEN 'CRITICAL' WHEN coalesce(symbols, 0) < 5 THEN 'LOW' WHEN symbols <= 15 THEN 'MEDIUM' ELSE 'HIGH' END AS risk,
  coalesce(files, '') AS importing_files, CAST(0 AS BIGINT) AS dropped, coalesce(tests, 0) AS tests_skipped FROM own LEFT JOIN c USING (source) LEFT JOIN g USING (source) LEFT JOIN f USING (source) LEFT JOIN t USING (source)""")
def impact_risk(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    t = _targets(g)
    found = code.impact(t, g["symbol"], g["calls"], g["inherits"], max_depth=2)
    return code.impact_summary(t, found, g["symbol"], g["calls"], g["inherits"], g["imports"]).withColumn("importing_files", F.array_join("importing_files", " ")).withColumn("dropped", F.col("dropped").cast("long"))


@query(f"""WITH {CODE_SQL}, t AS (SELECT id AS source, file_path FROM symbol WHERE kind = 'class')
SELECT DISTINCT * FROM (SELECT source, 'container' AS relation, parent AS other FROM t JOIN member ON child = source UNION ALL SELECT source, 'member', child FROM t JOIN member ON parent = source
UNION ALL SELECT source, 'caller', src FROM t JOIN calls ON dst = source UNION ALL SELECT source, 'callee', dst FROM t JOIN calls ON src = source UNION ALL SELECT source, 'base', dst FROM t JOIN inherits ON src = source
UNION ALL SELECT source, 'derived', src FROM t JOIN inherits ON dst = source UNION ALL SELECT source, 'imports', dst FROM t JOIN imports ON src = file_path UNION ALL SELECT source, 'imported_by', src FROM t JOIN imports ON dst = file_path) x""")
def symbol_context(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.context(_targets(g), g["symbol"], g["calls"], g["inherits"], g["imports"])


TRACE_SQL = f"""{CODE_SQL}, walk AS (SELECT src, dst, confidence FROM calls WHERE src NOT IN (SELECT id FROM symbol WHERE is_test) UNION ALL SELECT parent, child, 1.0 FROM member WHERE parent NOT IN (SELECT id FROM symbol WHERE is_test)),
targets AS (SELECT id AS source, id AS node FROM symbol WHERE kind = 'class'), goal AS (SELECT a.id AS source, b.id AS target FROM symbol a JOIN symbol b ON b.p = a.p // 8 WHERE a.kind = 'class'), {levels_sql('walk', 'targets', 10)}"""


@query(f"WITH {TRACE_SQL} SELECT g.source, g.target, CASE WHEN depth IS NULL THEN 'no_path' ELSE 'ok' END AS status, CAST(depth AS INT) AS hops FROM goal g LEFT JOIN found f ON f.source = g.source AND f.node = g.target")
def shortest_path(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    a = g["symbol"].where("kind = 'class'").select(F.col("id").alias("source"), F.floor(F.col("p") / 8).alias("q"))
    pairs = a.join(g["symbol"].select(F.col("p").alias("q"), F.col("id").alias("target")), "q").select("source", "target")
    return code.trace(pairs, g["symbol"], g["calls"]).select("source", "target", "status", "hops")


ENTRY_SQL = "entry AS (SELECT s.id, count(*) AS out_degree FROM symbol s JOIN calls c ON c.src = s.id WHERE s.kind <> 'class' AND NOT s.is_test AND s.id NOT IN (SELECT dst FROM calls) GROUP BY 1)"


@query(f"WITH {CODE_SQL}, {ENTRY_SQL} SELECT id, out_degree FROM entry")
def entry_points(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.entry_points(g["symbol"], g["calls"])


FLOW_SQL = f"""{CODE_SQL}, {ENTRY_SQL}, chosen AS (SELECT id AS source, id AS node FROM entry ORDER BY out_degree DESC, id LIMIT 400),
go AS (SELECT src, dst, confidence FROM calls WHERE dst NOT IN (SELECT id FROM symbol WHERE is_test) UNION ALL SELECT parent, child, 1.0 FROM member WHERE child NOT IN (SELECT id FROM symbol WHERE is_test)),
{levels_sql('go', 'chosen', 6)}, steps AS (SELECT replace(source, 'Symbol:', 'Process:') AS process_id, node AS symbol_id, CAST(depth AS INT) AS depth, row_number() OVER (PARTITION BY source ORDER BY depth, confidence DESC, node) AS step, count(*) OVER (PARTITION BY source) > 60 AS truncated FROM found WHERE depth > 0),
flow AS (SELECT process_id, symbol_id, depth, CAST(step AS INT) AS step, truncated FROM steps WHERE step <= 60)"""


@query(f"WITH {FLOW_SQL} SELECT flow.*, (SELECT greatest(0, count(*) - 400) FROM entry) AS omitted FROM flow")
def flows(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.flows(g["symbol"], g["calls"]).drop("via")


@query(f"WITH {FLOW_SQL} SELECT process_id, min(depth) AS depth FROM flow JOIN symbol s ON s.id = symbol_id WHERE s.kind = 'class' GROUP BY 1")
def flows_of_symbols(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.flows_of(code.flows(g["symbol"], g["calls"]), _targets(g))


# Call sites by part: the name of a neighbouring part, from a file some steps away.
SITES_SQL = """sites AS (SELECT 'k' || a.p AS call_id, a.file_path, b.name, CASE WHEN b.kind = 'class' AND a.p % 2 = 0 THEN 'new' ELSE 'call' END AS use, NULL::VARCHAR AS receiver,
  CASE WHEN a.p % 5 = 0 THEN 'C' || (b.p - b.p % 4) END AS receiver_type FROM symbol a JOIN symbol b ON b.p = CASE WHEN a.p % 2 = 0 THEN a.p + 1 ELSE a.p // 2 END)"""


def _sites(g):
    s = g["symbol"]
    b = s.select(F.col("p").alias("q"), "name", F.col("kind").alias("b_kind"))
    a = s.select("p", "file_path").withColumn("q", F.when(F.col("p") % 2 == 0, F.col("p") + 1).otherwise(F.floor(F.col("p") / 2)))
    kind = F.when((F.col("b_kind") == "class") & (F.col("p") % 2 == 0), "new").otherwise("call")
    kin = F.when(F.col("p") % 5 == 0, F.concat(F.lit("C"), (F.col("q") - F.col("q") % 4).cast("string")))
    return a.join(b, "q").select(F.concat(F.lit("k"), "p").alias("call_id"), "file_path", "name", kind.alias("kind"), F.lit(None).cast("string").alias("receiver"), kin.alias("receiver_type"))


def _rule(name, fit):
    n = "fit" if fit else "id IS NOT NULL"
    tests = {"type": "receiver_type IS NOT NULL AND owner = receiver_type", "file": "target_file = file_path", "import": "imported", "unique": "true"}
    return f"count_if(({tests[name]}) AND {n})", f"max(CASE WHEN ({tests[name]}) AND {n} THEN id END)"


def _cascade():
    picks, labels = "", ""
    for name in ("type", "file", "import", "unique"):
        (nf, idf), (na, ida) = _rule(name, True), _rule(name, False)
        one = f"(CASE WHEN count_if(fit) > 0 THEN {nf} ELSE {na} END) = 1"
        picks += f" WHEN {one} THEN (CASE WHEN count_if(fit) > 0 THEN {idf} ELSE {ida} END)"
        labels += f" WHEN {one} THEN '{name}'"
    return f"CASE{picks} END AS id, CASE{labels} END AS confidence"


@query(f"""WITH {CODE_SQL}, {SITES_SQL}, c AS (SELECT call_id, t.file_path, use, receiver_type, s.id, s.file_path AS target_file, regexp_extract(regexp_replace(s.id, '^.*:', ''), '([^.]*)\\.[^.]*$', 1) AS owner, i.src IS NOT NULL AS imported,
  CASE WHEN use = 'new' THEN s.kind = 'class' ELSE s.kind = 'method' END AS fit FROM sites t LEFT JOIN symbol s ON s.name = t.name LEFT JOIN imports i ON i.src = t.file_path AND i.dst = s.file_path),
r AS (SELECT call_id, {_cascade()}, count(id) AS n FROM c GROUP BY call_id) SELECT call_id, id, confidence, CASE WHEN n = 0 THEN 'external' WHEN id IS NULL THEN 'ambiguous' END AS reason FROM r""")
def name_resolution(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.choose(_sites(g), g["symbol"].drop("p", "size"), g["imports"])


@query(f"""WITH {CODE_SQL}, {SITES_SQL}, named AS (SELECT t.call_id, s.id, s.file_path, s.is_test FROM (SELECT DISTINCT call_id, name FROM sites) t JOIN symbol s ON s.name = t.name),
d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM calls UNION ALL SELECT dst FROM calls UNION ALL SELECT src FROM inherits UNION ALL SELECT dst FROM inherits) x GROUP BY 1)
SELECT call_id AS query_id, CASE WHEN count(*) OVER (PARTITION BY call_id) = 1 THEN 'ok' ELSE 'ambiguous' END AS status, id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY is_test::INT, coalesce(degree, 0) DESC, file_path, id) AS INT) AS rank FROM named LEFT JOIN d USING (id)""")
def resolve_targets(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    asked = _sites(g).select(F.col("call_id").alias("query_id"), "name", F.lit(None).cast("string").alias("uid"), F.lit(None).cast("string").alias("file")).distinct()
    return code.resolve_targets(asked, g["symbol"].drop("p", "size"), g["calls"], g["inherits"])


# Hunks by part: one in four files changes, at lines that move with the part.
HUNKS_SQL = """hunks AS (SELECT file_path AS file, CASE WHEN min(p) % 3 = 0 THEN 'deleted' ELSE 'modified' END AS status, CAST(12 AS INT) AS old_start, CAST(min(p) % 4 * 3 AS INT) AS old_lines, CAST(12 AS INT) AS new_start, CAST(min(p) % 2 * 5 AS INT) AS new_lines FROM symbol GROUP BY 1
  UNION ALL SELECT file_path, CASE WHEN min(p) % 3 = 0 THEN 'deleted' ELSE 'modified' END, 90, 2, 90, 2 FROM symbol GROUP BY 1 UNION ALL VALUES ('src/new.ts', 'added', 0, 0, 1, 9)),
touched AS (SELECT h.*, s.id, s.start_line, s.end_line FROM hunks h JOIN symbol s ON s.file_path = h.file WHERE s.start_line <= CASE WHEN old_lines = 0 THEN old_start ELSE old_start + old_lines - 1 END AND s.end_line >= old_start),
gone AS (SELECT file, bool_and(status = 'deleted') AS dead FROM hunks GROUP BY 1),
changed AS (SELECT id, file, CASE WHEN bool_or((old_start <= start_line AND old_start + old_lines - 1 >= end_line AND new_lines = 0) OR dead) THEN 'removed' ELSE 'modified' END AS change, file LIKE 'tests/%' AS is_test FROM touched JOIN gone USING (file) GROUP BY id, file)"""


def _hunks(spark, g):
    f = g["symbol"].groupBy(F.col("file_path").alias("file")).agg(F.min("p").alias("m"))
    status = F.when(F.col("m") % 3 == 0, "deleted").otherwise("modified")
    one = f.select("file", status.alias("status"), F.lit(12).alias("old_start"), (F.col("m") % 4 * 3).cast("int").alias("old_lines"), F.lit(12).alias("new_start"), (F.col("m") % 2 * 5).cast("int").alias("new_lines"))
    two = f.select("file", status.alias("status"), F.lit(90).alias("old_start"), F.lit(2).alias("old_lines"), F.lit(90).alias("new_start"), F.lit(2).alias("new_lines"))
    new = values(spark, [("src/new.ts", "added", 0, 0, 1, 9)], "file string, status string, old_start int, old_lines int, new_start int, new_lines int")
    return one.unionByName(two).unionByName(new)


@query(f"WITH {CODE_SQL}, {HUNKS_SQL} SELECT * FROM changed")
def diff_to_symbols(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.changed_symbols(_hunks(spark, g), g["symbol"])


@query(f"""WITH {CODE_SQL}, {HUNKS_SQL}, h AS (SELECT file, count(*) AS hunks FROM hunks GROUP BY 1), m AS (SELECT file, count(DISTINCT id) AS symbols, count(DISTINCT old_start) AS matched FROM touched GROUP BY 1)
SELECT file, coalesce(symbols, 0) AS symbols, hunks - coalesce(matched, 0) AS unmatched_hunks, file NOT IN (SELECT file_path FROM symbol) AS unindexed, file LIKE 'tests/%' AS is_test FROM h LEFT JOIN m USING (file)""")
def changed_files(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.changed_files(_hunks(spark, g), g["symbol"])


@query(f"""WITH {CODE_SQL}, {UP_SQL}, {HUNKS_SQL}, targets AS (SELECT id AS source, id AS node FROM changed WHERE NOT is_test), {levels_sql('up', 'targets', 1)}
SELECT c.id, c.file, c.change, (SELECT count(*) FROM found f WHERE f.source = c.id AND depth > 0) AS symbols, (SELECT count(*) FROM found f WHERE f.source = c.id AND depth = 1) AS direct FROM changed c WHERE NOT is_test""")
def detect_changes(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    none = spark.createDataFrame([], "process_id string, symbol_id string")
    return code.detect_changes(_hunks(spark, g), g["symbol"], g["calls"], g["inherits"], g["imports"], none, max_depth=1).drop("risk", "processes")


@query(f"WITH {CODE_SQL} SELECT array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/') AS module, count(*) AS files, CAST(sum(n) AS BIGINT) AS symbols FROM (SELECT file_path, count(*) AS n FROM symbol GROUP BY 1) x GROUP BY 1")
def module_rollup(spark, sf_dir):
    f = code_graph(spark, sf_dir)["symbol"].groupBy(F.col("file_path").alias("file")).agg(F.count("*").alias("symbols"))
    return code.module_rollup(f)


@query("""WITH h AS (SELECT l_partkey AS file, l_suppkey AS author, count(*) AS commits FROM lineitem GROUP BY 1, 2) SELECT author, CAST(sum(commits) AS BIGINT) AS commits, count(DISTINCT file) AS files FROM h WHERE file IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1 ORDER BY commits DESC, files DESC, author LIMIT 5""")
def reviewer_rollup(spark, sf_dir):
    history = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author")).agg(F.count("*").alias("commits"))
    return code.reviewers(history, table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("file")))


@query(f"""WITH RECURSIVE {CODE_SQL}, reach(a, b) AS (SELECT src, dst FROM imports UNION SELECT a, dst FROM reach JOIN imports ON b = src), c AS (SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT string_agg(node, ' ' ORDER BY node) AS files, count(*) AS n FROM c GROUP BY component""")
def import_cycles(spark, sf_dir):
    return code.import_cycles(code_graph(spark, sf_dir)["imports"]).select(F.array_join("files", " ").alias("files"), F.size("files").cast("long").alias("n"))


@query(f"""WITH {CODE_SQL}, quiet AS (SELECT id FROM symbol WHERE kind <> 'class' AND p % 31 = 5), e AS (SELECT src, dst FROM calls UNION ALL SELECT src, dst FROM inherits), held AS (SELECT * FROM e WHERE src NOT IN (SELECT id FROM quiet) AND dst NOT IN (SELECT id FROM quiet))
SELECT id AS subject FROM symbol WHERE kind <> 'class' AND NOT is_test AND id NOT IN (SELECT src FROM held UNION SELECT dst FROM held)""")
def check_isolated(spark, sf_dir):
    """A graph from which the edges of every 31st declaration are taken out."""
    g = code_graph(spark, sf_dir)
    quiet = g["symbol"].where("kind <> 'class' AND p % 31 = 5").select("id")
    kept = {name: g[name].join(quiet.withColumnRenamed("id", "src"), "src", "left_anti").join(quiet.withColumnRenamed("id", "dst"), "dst", "left_anti") for name in ("calls", "inherits")}
    return code.check(g["symbol"], kept["calls"], kept["inherits"], g["imports"]).where("kind = 'isolated'").select("subject")


@query(f"""WITH {CODE_SQL}, m AS (SELECT id, array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/') AS module FROM symbol)
SELECT a.module AS from_module, b.module AS to_module, count(*) AS calls FROM calls c JOIN m a ON a.id = c.src JOIN m b ON b.id = c.dst WHERE a.module <> b.module GROUP BY 1, 2""")
def crossing_counts(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    return code.crossing_counts(g["symbol"], g["calls"])


@query(f"""WITH {CODE_SQL} SELECT id, file_path, kind, coalesce((SELECT string_agg(DISTINCT dst, ' ' ORDER BY dst) FROM calls WHERE src = id), '') AS calls, coalesce((SELECT string_agg(DISTINCT src, ' ' ORDER BY src) FROM calls WHERE dst = id), '') AS called_by,
coalesce((SELECT string_agg(DISTINCT dst, ' ' ORDER BY dst) FROM inherits WHERE src = id), '') AS bases FROM symbol""")
def symbol_map(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    m = code.symbol_map(g["symbol"], g["calls"], g["inherits"], spark.createDataFrame([], "memory_id string, symbol_id string"))
    return m.select("id", "file_path", "kind", *[F.array_join(c, " ").alias(c) for c in ("calls", "called_by", "bases")])


ASK = [("q1", "fn m3"), ("q2", "C12"), ("q3", "src f4 fn41")]


@query(f"""WITH {CODE_SQL}, {sql_values('asked', 'query_id, term', [(q, t) for q, text in ASK for t in text.lower().split()])},
n AS (SELECT query_id, count(*) AS n FROM asked GROUP BY 1), w AS (SELECT id, lower(name) AS name, string_split(regexp_replace(lower(file_path), '[_./-]+', ' ', 'g'), ' ') AS path FROM symbol WHERE NOT is_test),
s AS (SELECT query_id, id, round(sum(CASE WHEN name = term THEN 1.0 WHEN list_contains(path, term) THEN 0.4 WHEN starts_with(name, term) OR starts_with(term, name) THEN 0.5 ELSE 0 END) / any_value(n), 4) AS score FROM asked JOIN n USING (query_id), w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) SELECT query_id, id, score::DOUBLE AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def code_query(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    none = spark.createDataFrame([], "process_id string, symbol_id string, depth int")
    return code.query(values(spark, ASK, "query_id string, text string"), g["symbol"].drop("p", "size"), none).select("query_id", "id", "score", "rank")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate) AS t0 FROM orders), s AS (SELECT o_orderkey AS id, o_custkey, t0 AS a, t0 + 86400 * (10 + o_orderkey % 90) AS b FROM o),
r AS (SELECT o.o_orderkey, s.id, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY s.b - s.a, s.id) AS rn FROM o JOIN s ON s.o_custkey = o.o_custkey AND o.t0 BETWEEN s.a AND s.b) SELECT o_orderkey, id AS handler FROM r WHERE rn = 1""")
def innermost_enclosing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("file_path"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("line"))
    s = o.select("file_path", F.col("o_orderkey").alias("id"), F.col("line").alias("start_line"), (F.col("line") + 86400 * (10 + F.col("o_orderkey") % 90)).alias("end_line"))
    return surface.enclosing(o, s).select("o_orderkey", "handler")


# Links of pages as HTTP calls, page URLs as routes.
LINKS_SQL = r"""l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


@query(f"WITH {LINKS_SQL} SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY 1")
def extract_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


NORMAL = "CASE WHEN regexp_replace({0}, '/+$', '') = '' THEN '/' ELSE lower(regexp_replace({0}, '/+$', '')) END"


@query(rf"""WITH r AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ANY' ELSE 'GET' END AS method, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') AS path FROM pages),
c AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') || '/' AS path FROM pages)
SELECT c.page_id AS call, r.page_id AS route, 0.77::DOUBLE AS confidence FROM c JOIN r ON {NORMAL.format('c.path')} = {NORMAL.format('r.path')} AND (c.method = r.method OR r.method = 'ANY')""")
def contracts_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = surface.path_of(F.col("url"))
    routes = pages.select(F.lit("b").alias("repo"), F.when(F.col("page_id") % 3 == 0, "ANY").otherwise("GET").alias("method"), path.alias("path"), F.col("page_id").cast("string").alias("handler"), F.lit(0.9).alias("confidence"))
    calls = pages.select(F.lit("a").alias("repo"), F.lit("f").alias("file_path"), F.col("page_id").alias("line"), F.when(F.col("page_id") % 5 == 0, "POST").otherwise("GET").alias("method"), F.concat(path, F.lit("/")).alias("path"), F.lit(None).cast("string").alias("caller"), F.lit(0.85).alias("confidence"))
    return surface.contracts(routes, calls)[0].select(F.col("line").alias("call"), F.col("handler").cast("long").alias("route"), "confidence")


MARK_SQL = """marked AS (SELECT id AS symbol_id, CASE WHEN size <= 5 THEN 'source' WHEN size >= 46 THEN 'sink' ELSE 'sanitizer' END AS role, p AS line FROM symbol WHERE NOT is_test AND (size <= 5 OR size >= 46 OR size = 25))"""


@query(f"""WITH {CODE_SQL}, {MARK_SQL}, hop AS (SELECT DISTINCT src, dst, 1.0::DOUBLE AS confidence FROM calls), starts AS (SELECT symbol_id AS source, symbol_id AS node FROM marked WHERE role = 'source'), {levels_sql('hop', 'starts', 3)}
SELECT f.source AS source_id, a.line AS source_line, f.node AS sink_id, b.line AS sink_line, CAST(depth AS INT) AS depth FROM found f JOIN marked a ON a.symbol_id = f.source AND a.role = 'source' JOIN marked b ON b.symbol_id = f.node AND b.role = 'sink'""")
def taint_paths(spark, sf_dir):
    g = code_graph(spark, sf_dir)
    s = g["symbol"].where("file_path NOT LIKE 'tests/%' AND (size <= 5 OR size >= 46 OR size = 25)")
    role = F.when(F.col("size") <= 5, "source").when(F.col("size") >= 46, "sink").otherwise("sanitizer")
    marked = s.select(F.col("id").alias("symbol_id"), role.alias("role"), role.alias("marker"), F.col("p").alias("line"))
    return surface.taint_of(marked, g["calls"]).select("source_id", "source_line", "sink_id", "sink_line", "depth")


#: Two files for each supplier; # stands for the key.
SOURCE_TEXT = [("src/app#.ts", "app.get('/users#/:id', handler)\nfetch(`/api/orders#/${id}`)\nconst r = axios.post('/api/orders#')\nrouter.delete(path, h)\nconst x = 1"), ("web/views#.py", "@app.route('/a#', methods=['GET', 'POST'])\ndef a():\n    return requests.get('http://host/x#?y=1')\n@router.get('/b')\ndef b():\n    pass")]


def _sources(spark, sf_dir):
    """path, text of source files, two for each supplier."""
    texts = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in SOURCE_TEXT))).alias("f")
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(key.alias("k"), texts).select(F.replace("f.path", F.lit("#"), F.col("k")).alias("path"), F.replace("f.text", F.lit("#"), F.col("k")).alias("text"))


def _for_each_supplier(columns, rows):
    """Rows told for each supplier, # in them being the key."""
    held = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT {', '.join(f'replace({c}, chr(35), s_suppkey::VARCHAR) AS {c}' if isinstance(rows[0][n], str) else c for n, c in enumerate(columns))} FROM supplier, (VALUES {held}) t({', '.join(columns)})"


@query(_for_each_supplier(["method", "path", "framework", "file_path", "line", "confidence"], [("GET", "/users#/:id", "express-style", "src/app#.ts", 1, 0.9), ("DELETE", None, "express-style", "src/app#.ts", 4, 0.4), ("GET", "/a#", "flask", "web/views#.py", 1, 0.9), ("POST", "/a#", "flask", "web/views#.py", 1, 0.9), ("GET", "/b", "express-style", "web/views#.py", 4, 0.9)]))
def route_map(spark, sf_dir):
    none = spark.createDataFrame([], "id string, file_path string, start_line int, end_line int")
    return surface.route_map(lines(_sources(spark, sf_dir)), none).select("method", "path", "framework", "file_path", "line", F.col("confidence").cast("double").alias("confidence"))


@query(_for_each_supplier(["method", "path", "file_path", "line", "confidence"], [("GET", "/api/orders#/${id}", "src/app#.ts", 2, 0.6), ("POST", "/api/orders#", "src/app#.ts", 3, 0.85), ("GET", "/x#", "web/views#.py", 3, 0.85)]))
def http_calls(spark, sf_dir):
    none = spark.createDataFrame([], "id string, file_path string, start_line int, end_line int")
    return surface.http_calls(lines(_sources(spark, sf_dir)), none).select("method", "path", "file_path", "line", F.col("confidence").cast("double").alias("confidence"))


#: A diff for each order: a changed file with two hunks, a new file, a deleted and a renamed one.
DIFF = "diff --git a/x#.ts b/x#.ts\n--- a/x#.ts\n+++ b/x#.ts\n@@ -#,2 +3,0 @@\n-a\n-b\n@@ -9 +# @@ f()\n-c\n+d\ndiff --git a/n#.ts b/n#.ts\nnew file mode 100644\n--- /dev/null\n+++ b/n#.ts\n@@ -0,0 +1,4 @@\n+x\ndiff --git a/g b/g\ndeleted file mode 100644\n--- a/g#.ts\n+++ /dev/null\n@@ -1,# +0,0 @@\n-x\ndiff --git a/o# b/p#\nrename from o#\nrename to p#\n--- a/o#\n+++ b/p#\n@@ -5 +5,# @@"


@query("""WITH k AS (SELECT o_orderkey AS k FROM orders) SELECT 'x' || k || '.ts' AS file, 'modified' AS status, k AS old_start, 2 AS old_lines, 3 AS new_start, 0 AS new_lines FROM k UNION ALL SELECT 'x' || k || '.ts', 'modified', 9, 1, k, 1 FROM k
UNION ALL SELECT 'n' || k || '.ts', 'added', 0, 0, 1, 4 FROM k UNION ALL SELECT 'g' || k || '.ts', 'deleted', 1, k, 0, 0 FROM k UNION ALL SELECT 'o' || k, 'renamed', 5, 1, 5, k FROM k""")
def diff_hunks(spark, sf_dir):
    """Diffs written as text files from orders, and read."""
    key = F.col("o_orderkey").cast("string")
    place = f"{shared_dir(spark)}/tessera/diffs-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select(F.replace(F.lit(DIFF), F.lit("#"), key).alias("value")).write.option("lineSep", "\x1e").text(place)
    return read_diff(spark, place, "\x1e")
