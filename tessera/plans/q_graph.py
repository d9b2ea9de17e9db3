"""Queries: property graph, memory operators, components and communities."""

from pyspark.sql import functions as F

from tessera.functions.text import token_set
from tessera.graph.components import connected_components
from tessera.graph.frontier import search as breadth_first
from tessera.graph.structure import communities, modularity, strong_components
from tessera.operators import memory, retrieval
from tessera.plans.catalogue import levels_sql, query, terms_sql
from tessera.session import keep, table

# Suppliers and parts as a bipartite graph: an edge where an order has both.
SUPPLY_SQL = """raw AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
both_ways AS (SELECT a AS src, b AS dst, 1.0::DOUBLE AS confidence FROM raw UNION ALL SELECT b, a, 1.0 FROM raw)"""


def _supply(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct().withColumn("type", F.lit("CONSTRAINS")).withColumn("weight", F.lit(0.8))


def _neighbors(depth):
    sql = f"""WITH {SUPPLY_SQL}, seeds AS (SELECT 's' || s_suppkey AS source, 's' || s_suppkey AS node FROM supplier WHERE s_nationkey = 3), {levels_sql('both_ways', 'seeds', depth)},
scored AS (SELECT source, node, depth AS hops, round(0.8 * pow(0.5, depth - 1), 6) AS score FROM found WHERE depth > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hops, score DESC, node) AS rank FROM scored) SELECT source, node, CAST(hops AS INT) AS hops, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 50"""

    def run(spark, sf_dir):
        starts = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("node"))
        return memory.neighbors(_supply(spark, sf_dir), starts, depth=depth).drop("via")

    run.__name__ = f"neighbors_bfs_d{depth}"
    return query(sql)(run)


neighbors_bfs_d1, neighbors_bfs_d2, neighbors_bfs_d4 = (_neighbors(d) for d in (1, 2, 4))

KNN_SQL = """cos AS (SELECT q.vec_id AS a, e.vec_id AS b, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 5) AS s
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id), kr AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM cos), knn AS (SELECT a AS src, b AS dst FROM kr WHERE rn <= 3)"""


def _knn(spark, sf_dir):
    """The three nearest of all vectors, from each."""
    e = table(spark, sf_dir, "embeddings")
    near = retrieval.semantic_top(e, e.select(F.col("vec_id").alias("query_id"), "embedding"), 4, 2.0, id_col="vec_id").where("query_id <> node_id")
    w = F.row_number().over(retrieval.W.partitionBy("query_id").orderBy("rank"))
    return near.withColumn("rn", w).where("rn <= 3").select(F.col("query_id").alias("src"), F.col("node_id").alias("dst"))


@query(f"""WITH {KNN_SQL}, seeds AS (SELECT label AS query_id, vec_id AS node_id FROM embeddings WHERE embedding[1] > 0), both_ways AS (SELECT src, dst FROM knn UNION ALL SELECT dst, src FROM knn),
hit AS (SELECT query_id, dst AS node_id, count(*) AS support FROM seeds JOIN both_ways ON src = node_id GROUP BY 1, 2), fresh AS (SELECT * FROM hit WHERE (query_id, node_id) NOT IN (SELECT query_id, node_id FROM seeds)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, node_id) AS rank FROM fresh) SELECT query_id, node_id, support, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def one_hop_graph_branch(spark, sf_dir):
    seeds = table(spark, sf_dir, "embeddings").where("embedding[0] > 0").select(F.col("label").alias("query_id"), F.col("vec_id").alias("node_id"))
    return retrieval.graph_rank(seeds, _knn(spark, sf_dir), None, 10)


# Memory rows made from customers: market segments as layers, account balance as importance, nations in titles.
LAYER_OF = "CASE c_mktsegment WHEN 'BUILDING' THEN 'semantic' WHEN 'AUTOMOBILE' THEN 'episodic' WHEN 'MACHINERY' THEN 'procedural' ELSE 'artifact' END"
MEMORY_SQL = f"""mem AS (SELECT 'c' || c_custkey AS id, {LAYER_OF} AS layer, c_name || ' ' || n_name AS title, c_acctbal AS importance, 1700000000000 + c_custkey::BIGINT * 86400000 AS created_at, c_custkey AS k, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
LINKS_SQL = "links AS (SELECT DISTINCT 'c' || a.c_custkey AS src, 'c' || b.c_custkey AS dst FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey // 3 WHERE a.c_mktsegment = 'BUILDING' AND a.c_custkey >= 3)"


def _memory(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    layer = F.when(F.col("c_mktsegment") == "BUILDING", "semantic").when(F.col("c_mktsegment") == "AUTOMOBILE", "episodic").when(F.col("c_mktsegment") == "MACHINERY", "procedural").otherwise("artifact")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), layer.alias("layer"), F.concat_ws(" ", "c_name", "n_name").alias("title"), F.lit("").alias("body"), F.concat(F.lit("f"), "c_nationkey").alias("source_ref"), F.concat(F.lit("src/n"), "c_nationkey").alias("file_path"),
        F.col("c_acctbal").alias("importance"), (F.lit(1700000000000) + F.col("c_custkey") * 86400000).cast("long").alias("created_at"), F.lit(None).cast("long").alias("superseded_at"), F.col("c_custkey").alias("k"),
    )


def _links(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    c = rows.select("c_custkey")
    a = rows.where("c_mktsegment = 'BUILDING' AND c_custkey >= 3").select("c_custkey").withColumn("t", F.floor(F.col("c_custkey") / 3))
    return a.join(c.withColumnRenamed("c_custkey", "t"), "t").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("c"), "t").alias("dst"), F.lit("RESOLVES").alias("type"), F.lit(1.0).alias("weight"))


@query(f"WITH {MEMORY_SQL} SELECT id, layer, importance, created_at FROM mem WHERE layer = 'semantic' ORDER BY importance DESC, created_at DESC, id LIMIT 25")
def constraints_topk(spark, sf_dir):
    return memory.constraints(_memory(spark, sf_dir), 25).select("id", "layer", "importance", "created_at")


@query(f"WITH {MEMORY_SQL}, {LINKS_SQL} SELECT id, layer FROM mem WHERE layer <> 'artifact' AND id NOT IN (SELECT src FROM links UNION SELECT dst FROM links)")
def orphans(spark, sf_dir):
    return memory.orphans(_memory(spark, sf_dir), _links(spark, sf_dir)).select("id", "layer")


@query(f"""WITH {MEMORY_SQL}, {LINKS_SQL} SELECT id, CASE layer WHEN 'episodic' THEN 2 ELSE 3 END AS weight FROM mem WHERE layer IN ('episodic', 'artifact') AND created_at < 1700000000000 + (SELECT max(k) FROM mem) * 86400000 - 7776000000
AND id NOT IN (SELECT src FROM links UNION SELECT dst FROM links)""")
def prune_candidates(spark, sf_dir):
    rows = _memory(spark, sf_dir)
    now = rows.agg(F.max("created_at")).first()[0]
    return memory.prune_candidates(rows, F.lit(now), _links(spark, sf_dir), layer=None, max_weight=3).select("id", "weight")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def customers_without_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return memory.without_links(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), orders)


TITLE = "regexp_extract(text, '^[^.]*', 0)"


@query(f"""WITH d AS (SELECT doc_id, {TITLE} AS title FROM documents), {terms_sql('d', 'doc_id', 'title', 't')}, s AS (SELECT DISTINCT node_id, term FROM t), n AS (SELECT node_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.node_id AS a, y.node_id AS b, count(*) AS common FROM s x JOIN s y ON x.term = y.term AND x.node_id < y.node_id GROUP BY 1, 2)
SELECT a, b, 'suspected' AS kind, round(common / (na.n + nb.n - common), 6) AS similarity FROM p JOIN n na ON na.node_id = a JOIN n nb ON nb.node_id = b WHERE common / (na.n + nb.n - common) >= 0.6""")
def suspected_conflicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("semantic").alias("layer"), F.regexp_extract("text", "^[^.]*", 0).alias("title"), F.lit(None).cast("long").alias("superseded_at"))
    none = spark.createDataFrame([], "src long, dst long, type string")
    titles = keep(docs.select("id", "layer", "title", "superseded_at"), "titles")
    return memory.conflicts(titles, none)


@query(f"""WITH d AS (SELECT doc_id, {TITLE} AS title FROM documents), {terms_sql('d', 'doc_id', 'title', 't')} SELECT node_id, count(DISTINCT term) AS n FROM t GROUP BY 1""")
def title_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("node_id"), F.size(token_set(F.regexp_extract("text", "^[^.]*", 0))).cast("long").alias("n")).where("n > 0")


TRANS_SQL = """trans AS (SELECT DISTINCT event_type AS src, nxt AS dst FROM (SELECT user_id, event_type || '/' || (event_id % 40) AS event_type, lead(event_type || '/' || (event_id % 40)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, event_id FROM events) WHERE nxt IS NOT NULL)"""


def _trans(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("state", F.concat_ws("/", "event_type", (F.col("event_id") % 40).cast("string")))
    nxt = F.lead("state").over(retrieval.W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("dst", nxt).where("dst IS NOT NULL").select(F.col("state").alias("src"), "dst").distinct()


@query(f"""WITH RECURSIVE {TRANS_SQL}, reach(a, b) AS (SELECT src, dst FROM trans UNION SELECT a, dst FROM reach JOIN trans ON b = src),
mutual AS (SELECT x.a AS node, min(least(x.b, x.a)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT node, component FROM mutual""")
def strong_components_trans(spark, sf_dir):
    parts = strong_components(_trans(spark, sf_dir))
    least = parts.groupBy("component").agg(F.min("node").alias("least"))
    return parts.join(least, "component").select("node", F.col("least").alias("component"))


@query("""WITH RECURSIVE w AS (SELECT DISTINCT doc_id, unnest(string_split(text, '. ')) AS s FROM documents), e AS (SELECT DISTINCT doc_id AS a, min(doc_id) OVER (PARTITION BY s) AS b FROM w WHERE length(s) >= 60),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a""")
def components(spark, sf_dir):
    """Documents that share a sentence of at least 60 characters, wherever it stands, and those they lead to."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", r"\. "))).alias("s")).where(F.length("s") >= 60)
    d = d.select("doc_id", F.xxhash64("s").alias("h"))
    least = d.groupBy("h").agg(F.min("doc_id").alias("dst"))
    return connected_components(d.join(least, "h").select(F.col("doc_id").alias("src"), "dst"))


@query(f"WITH {KNN_SQL}, n AS (SELECT src AS node FROM knn UNION SELECT dst FROM knn) SELECT count(*) AS nodes, true AS once, true AS named_by_member, true AS better_than_chance FROM n")
def communities_knn(spark, sf_dir):
    """What holds of any good answer: every node is in one community, each is named by a member, and links inside are far above chance."""
    edges = keep(_knn(spark, sf_dir), "knn")
    found = keep(communities(edges), "communities")
    strangers = found.select("community").distinct().join(found.select(F.col("node").alias("community"), F.col("community").alias("own")).where("own = community"), "community", "left_anti")
    told = found.agg(F.count("*").alias("nodes"), F.count_distinct("node").alias("own"))
    return told.select("nodes", (F.col("nodes") == F.col("own")).alias("once"), F.lit(strangers.isEmpty()).alias("named_by_member"), F.lit(modularity(edges, found) > 0.3).alias("better_than_chance"))


@query(f"""WITH {SUPPLY_SQL}, seeds AS (SELECT 's' || s_suppkey AS source, 's' || s_suppkey AS node FROM supplier WHERE s_nationkey = 5), {levels_sql('both_ways', 'seeds', 3)} SELECT source, node, CAST(depth AS INT) AS depth, parent FROM found""")
def frontier_depth3(spark, sf_dir):
    e = _supply(spark, sf_dir).select("src", "dst")
    seeds = table(spark, sf_dir, "supplier").where("s_nationkey = 5").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return breadth_first(e.union(e.select("dst", "src")), seeds, 3).select("source", "node", "depth", "parent")


@query(f"""WITH {MEMORY_SQL}, {LINKS_SQL} SELECT 'layer' AS metric, layer AS key, count(*) AS "count" FROM mem GROUP BY 2 UNION ALL SELECT 'edge', 'RESOLVES', count(*) FROM links""")
def store_status(spark, sf_dir):
    rows = _memory(spark, sf_dir).withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_model": F.lit(None).cast("string"), "embedding_dims": F.lit(None).cast("int"), "embedding_provider": F.lit(None).cast("string")})
    return memory.status(rows, _links(spark, sf_dir), spark.createDataFrame([], "id string, kind string"))


@query(f"""WITH {MEMORY_SQL}, {LINKS_SQL}, o AS (SELECT count(*) AS n FROM mem WHERE layer <> 'artifact' AND id NOT IN (SELECT src FROM links UNION SELECT dst FROM links))
SELECT 'nodes' AS "check", CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status, CAST(count(*) AS VARCHAR) AS detail FROM mem
UNION ALL VALUES ('dangling edges', 'ok', '0')
UNION ALL SELECT 'vectors missing', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, CAST(count(*) AS VARCHAR) FROM mem
UNION ALL VALUES ('vector spaces', 'ok', '0')
UNION ALL SELECT 'index lag', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, CAST(count(*) AS VARCHAR) FROM mem WHERE c_nationkey = 5
UNION ALL VALUES ('tokenizer version', 'ok', '3')
UNION ALL SELECT 'orphans', CASE WHEN n = 0 THEN 'ok' ELSE 'warn' END, CAST(n AS VARCHAR) FROM o
UNION ALL VALUES ('unanchored', 'ok', '0'), ('resolve rate', 'empty', NULL), ('symbols', 'empty', '0')""")
def doctor_checks(spark, sf_dir):
    rows = _memory(spark, sf_dir).withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_model": F.lit(None).cast("string"), "embedding_dims": F.lit(None).cast("int"), "embedding_provider": F.lit(None).cast("string")})
    empty = lambda s: spark.createDataFrame([], s)
    return memory.doctor(spark, rows, _links(spark, sf_dir), empty("id string, kind string"), empty("src string, dst string"), empty("reason string"), rows.where("file_path <> 'src/n5'").select(F.col("id").alias("node_id")))


@query(f"""WITH {MEMORY_SQL}, {LINKS_SQL}, files AS (SELECT 'src/n' || n_nationkey AS path FROM nation WHERE n_regionkey = 1),
a AS (SELECT path, id AS memory_id, layer, importance FROM files JOIN mem ON path = 'src/n' || c_nationkey), k AS (SELECT *, bool_or(layer <> 'artifact') OVER (PARTITION BY path) AS reasoned FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY importance DESC, memory_id) AS rank FROM k WHERE NOT reasoned OR layer <> 'artifact')
SELECT path, memory_id, layer, importance, 'anchor' AS via, false AS contested, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def memory_changes(spark, sf_dir):
    files = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("src/n"), "n_nationkey").alias("path"))
    empty = lambda s: spark.createDataFrame([], s)
    return memory.changes(files, _memory(spark, sf_dir), empty("memory_id string, symbol_id string"), empty("id string, file_path string"), empty("src string, dst string"), _links(spark, sf_dir))


@query(f"""WITH {MEMORY_SQL}, asked AS (SELECT n_nationkey AS query_id, lower(n_name) AS term FROM nation), sym AS (SELECT 'y' || n_nationkey AS id, n_name AS name FROM nation),
about AS (SELECT id AS memory_id, 'y' || c_nationkey AS symbol_id FROM mem), calls AS (SELECT 'y' || n_nationkey AS src, 'y' || n_regionkey AS dst FROM nation),
named AS (SELECT DISTINCT query_id, s.id AS symbol_id FROM asked JOIN sym s ON lower(s.name) = term), steps AS (SELECT src AS symbol_id, dst AS nxt FROM calls UNION SELECT dst, src FROM calls),
reached AS (SELECT query_id, symbol_id, 0 AS via FROM named UNION ALL SELECT DISTINCT query_id, nxt, 1 FROM named JOIN steps USING (symbol_id)),
f AS (SELECT query_id, memory_id, min(via) AS via FROM reached JOIN about USING (symbol_id) GROUP BY 1, 2),
p AS (SELECT f.*, row_number() OVER (PARTITION BY query_id, via ORDER BY importance DESC, created_at DESC, memory_id) AS place FROM f JOIN mem ON mem.id = memory_id),
k AS (SELECT * FROM p WHERE place <= CASE WHEN via = 0 THEN 20 ELSE 10 END)
SELECT query_id, memory_id AS node_id, CAST(via AS INT) AS via, CAST(row_number() OVER (PARTITION BY query_id ORDER BY via, place) AS INT) AS rank FROM k""")
def entity_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = _memory(spark, sf_dir)
    sym = n.select(F.concat(F.lit("y"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    about = rows.select(F.col("id").alias("memory_id"), F.regexp_replace("source_ref", "^f", "y").alias("symbol_id"))
    calls = n.select(F.concat(F.lit("y"), "n_nationkey").alias("src"), F.concat(F.lit("y"), "n_regionkey").alias("dst"))
    return retrieval.entity_rank(n.select(F.col("n_nationkey").alias("query_id"), F.lower("n_name").alias("term")), rows, about, sym, calls, 10)
