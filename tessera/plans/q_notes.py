"""Queries: recorded notes, their links and upkeep, listings and suggestions."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.embed import Space, to_embed, with_provider
from tessera.functions.text import decision_excerpt, title_for, tokenize
from tessera.model import MEMORY
from tessera.operators import memory, reports, retrieval
from tessera.operators.index import document_frequency, postings, remove_documents
from tessera.plans.catalogue import CODE_SQL, QUESTIONS, code_graph, query, values
from tessera.plans.ingest import span_links, write_note
from tessera.plans.q_graph import LINKS_SQL, MEMORY_SQL, _links, _memory
from tessera.plans.q_text import BM25_SQL, POSTINGS_SQL, _terms
from tessera.plans.store import delete_nodes, restore_recorded, stale_chunks, supersede
from tessera.session import table

ANCHORED_SQL = f"""{MEMORY_SQL}, anchored AS (SELECT id, layer, importance, CASE k % 3 WHEN 0 THEN 'src/n' || c_nationkey WHEN 1 THEN 'app/src/n' || c_nationkey END AS file_path,
  CASE WHEN k % 2 = 0 THEN 'src/n' || c_nationkey || '#L' || k WHEN k % 5 = 0 THEN 'lib/src/n' || c_nationkey || '#L1' ELSE 'z' END AS source_ref FROM mem)"""
NEAR_3 = "(file_path = 'src/n3' OR ends_with(file_path, '/src/n3') OR starts_with(source_ref, 'src/n3#') OR contains(source_ref, '/src/n3'))"


def _anchored(spark, sf_dir):
    place = F.concat(F.lit("src/n"), F.regexp_replace("source_ref", "^f", ""))
    file = F.when(F.col("k") % 3 == 0, place).when(F.col("k") % 3 == 1, F.concat(F.lit("app/"), place))
    ref = F.when(F.col("k") % 2 == 0, F.concat(place, F.lit("#L"), F.col("k"))).when(F.col("k") % 5 == 0, F.concat(F.lit("lib/"), place, F.lit("#L1"))).otherwise("z")
    return _memory(spark, sf_dir).withColumns({"file_path": file, "source_ref": ref})


@query(f"WITH {ANCHORED_SQL} SELECT id FROM anchored WHERE {NEAR_3}")
def path_anchor(spark, sf_dir):
    return retrieval.path_anchor(_anchored(spark, sf_dir), "src/n3").select("id")


LAYER_ORDER = "CASE layer WHEN 'semantic' THEN 0 WHEN 'episodic' THEN 1 WHEN 'procedural' THEN 2 ELSE 3 END"


@query(f"WITH {ANCHORED_SQL} SELECT id AS node_id, CAST(row_number() OVER (ORDER BY {LAYER_ORDER}, importance DESC, id) AS INT) AS rank FROM anchored WHERE {NEAR_3} QUALIFY rank <= 10")
def why_anchored(spark, sf_dir):
    return retrieval.why(_anchored(spark, sf_dir), "src/n3", anchor_only=True).rows.select("node_id", "rank")


def _doc_notes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    layer = F.element_at(F.array(F.lit("semantic"), F.lit("episodic"), F.lit("procedural")), (F.col("doc_id") % 3 + 1).cast("int"))
    given = {"id": F.concat(F.lit("d"), "doc_id"), "layer": layer, "title": F.lit(""), "body": F.col("text"), "source_ref": F.lit("r"), "importance": (F.col("doc_id") % 7).cast("double"), "created_at": F.col("doc_id"), "file_path": F.when((F.col("lang") == "fr") & (F.col("doc_id") % 50 == 1), "src/x.ts")}
    return d.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MEMORY.fields])


ONLY_WORDS = ("semantic", "recency", "entity", "graph")
LISTED_SQL = f"""{BM25_SQL}, listed AS (SELECT query_id, 'd' || node_id AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'd' || node_id) AS place FROM bm)"""


@query(f"WITH {LISTED_SQL} SELECT query_id, node_id, CAST(place AS INT) AS place FROM listed WHERE place <= 30")
def index_listing(spark, sf_dir):
    asked = values(spark, QUESTIONS, "query_id string, text string")
    return retrieval.index(_doc_notes(spark, sf_dir), asked, disable=ONLY_WORDS).rows.select("query_id", "node_id", "place")


@query(f"""WITH {LISTED_SQL}, notes AS (SELECT 'd' || doc_id AS node_id, doc_id % 3 AS l, doc_id % 7 AS importance FROM documents WHERE lang = 'fr' AND doc_id % 50 = 1),
lead AS (SELECT node_id, row_number() OVER (ORDER BY l, importance DESC, node_id) AS rank, true AS anchored FROM notes QUALIFY rank <= 10),
rest AS (SELECT node_id, place + 1000000 AS rank, false AS anchored FROM listed WHERE query_id = 'q02' AND place <= 10 AND node_id NOT IN (SELECT node_id FROM lead))
SELECT * FROM (SELECT node_id, anchored, CAST(row_number() OVER (ORDER BY rank) AS INT) AS rank FROM (SELECT * FROM lead UNION ALL SELECT * FROM rest) x) y WHERE rank <= 10""")
def why_merged(spark, sf_dir):
    asked = values(spark, [q for q in QUESTIONS if q[0] == "q02"], "query_id string, text string").withColumn("query_id", F.lit("0"))
    return retrieval.why(_doc_notes(spark, sf_dir), "src/x.ts", queries=asked, disable=ONLY_WORDS).rows.select("node_id", "anchored", "rank")


@query(f"WITH {MEMORY_SQL}, {LINKS_SQL} SELECT 'node' AS what, id AS src, layer AS dst FROM mem WHERE id = 'c5' UNION ALL SELECT 'edge', src, dst FROM links WHERE src = 'c5' OR dst = 'c5'")
def get_node(spark, sf_dir):
    row, edges = retrieval.get(_memory(spark, sf_dir), _links(spark, sf_dir), "c5")
    return row.select(F.lit("node").alias("what"), F.col("id").alias("src"), F.col("layer").alias("dst")).unionByName(edges.select(F.lit("edge").alias("what"), "src", "dst"))


COS = "round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 5)"


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, 'v' || e.vec_id AS node_id, {COS} AS similarity FROM embeddings q JOIN embeddings e ON e.label <> 2 WHERE q.vec_id % 25 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - similarity, 5), node_id) AS rank FROM s) SELECT query_id, node_id, similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3 AND similarity >= 0.3""")
def nearby_suggestions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.when(F.col("label") == 2, "artifact").otherwise("semantic").alias("layer"), F.lit(None).cast("long").alias("superseded_at"), "embedding")
    return retrieval.nearby(rows, e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), least=0.3).select("query_id", "node_id", "similarity", "rank")


@query("SELECT 'sum' || c_nationkey AS src, 'c' || c_custkey AS dst, 'DERIVED_FROM' AS type, 1.0::DOUBLE AS weight, CAST(7 AS BIGINT) AS created_at FROM customer WHERE c_nationkey < 3")
def summarize_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.concat(F.lit("c"), "c_custkey").alias("node"))
    parts = [memory.summarize(c.where(F.col("c_nationkey") == n), f"sum{n}", 7).drop("evidence_ref") for n in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(rf"""WITH {MEMORY_SQL}, w AS (SELECT DISTINCT c_nationkey AS community, id, unnest(regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}]+')) AS term FROM mem), n AS (SELECT community, term, count(*) AS n FROM w WHERE length(term) > 3 GROUP BY 1, 2 HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, term) AS rank FROM n) SELECT community, string_agg(term, ' ' ORDER BY rank) AS terms FROM r WHERE rank <= 6 GROUP BY 1""")
def common_terms(spark, sf_dir):
    rows = _memory(spark, sf_dir).select(F.regexp_replace("source_ref", "^f", "").cast("int").alias("community"), "id", "title")
    return memory.common_terms(rows).select("community", F.array_join("terms", " ").alias("terms"))


@query("SELECT 'src/n' || n_nationkey AS path FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def uncovered_files(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("src/n"), "n_nationkey").alias("path"))
    found = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.concat(F.lit("src/n"), "c_nationkey").alias("path"))
    return memory.uncovered(files, found)


@query(f"WITH {MEMORY_SQL} SELECT id, CAST(CASE WHEN c_nationkey = 3 THEN CASE WHEN layer = 'semantic' THEN 5 ELSE 9 END END AS BIGINT) AS superseded_at FROM mem")
def superseded_rows(spark, sf_dir):
    rows = _memory(spark, sf_dir)
    third = rows.where("source_ref = 'f3'")
    once = supersede(rows, third.where("layer = 'semantic'").select("id"), 5)
    return supersede(once, third.select("id"), 9).select("id", "superseded_at")


@query(f"WITH {MEMORY_SQL}, {LINKS_SQL}, g AS (SELECT id FROM mem WHERE c_nationkey < 5), t AS (SELECT src AS id FROM links UNION SELECT dst FROM links) SELECT id, 'refused' AS state FROM g WHERE id IN (SELECT id FROM t) UNION ALL SELECT id, 'left' FROM mem WHERE id NOT IN (SELECT id FROM g) OR id IN (SELECT id FROM t)")
def guarded_delete(spark, sf_dir):
    rows = _memory(spark, sf_dir)
    left, refused = delete_nodes(rows, rows.where("CAST(substring(source_ref, 2) AS int) < 5").select("id"), _links(spark, sf_dir))
    return refused.select("id", F.lit("refused").alias("state")).unionByName(left.select("id", F.lit("left").alias("state")))


@query(f"WITH {MEMORY_SQL}, a AS (SELECT id AS memory_id, 'y' || c_nationkey AS symbol_id, c_nationkey % 4 = 1 AS gone FROM mem) SELECT memory_id, symbol_id, CASE WHEN gone THEN 'lost' ELSE 'kept' END AS state FROM a")
def restored_links(spark, sf_dir):
    rows = _memory(spark, sf_dir)
    links = rows.select(F.col("id").alias("memory_id"), F.regexp_replace("source_ref", "^f", "y").alias("symbol_id"))
    symbol = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 1").select(F.concat(F.lit("y"), "n_nationkey").alias("id"))
    kept, lost = restore_recorded(links, symbol)
    return kept.withColumn("state", F.lit("kept")).unionByName(lost.withColumn("state", F.lit("lost")))


@query(f"WITH {MEMORY_SQL}, {LINKS_SQL}, shown AS (SELECT id FROM mem WHERE importance > 0) SELECT src, dst FROM links WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)")
def viewer_edges(spark, sf_dir):
    return reports.viewer_edges(_links(spark, sf_dir), _memory(spark, sf_dir).where("importance > 0")).select("src", "dst")


@query("SELECT 'd' || doc_id AS id FROM documents WHERE lang IN ('en', 'de') AND doc_id % 3 = 0 AND doc_id % 2 = 1")
def stale_chunks_of_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "artifact").otherwise("semantic").alias("layer"), F.col("lang").alias("file_path"), F.lit(None).cast("long").alias("superseded_at"))
    return stale_chunks(rows, rows.where("CAST(substring(id, 2) AS long) % 2 = 0"), values(spark, [("en",), ("de",)], "path string")).select("id")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'We chose ' || source || ' instead of ' || lang || '.' ELSE 'B' || doc_id || ' was rejected.' END AS excerpt FROM documents WHERE doc_id % 3 < 2""")
def decision_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Intro. We chose "), "source", F.lit(" instead of "), "lang", F.lit(". "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("We decided on A. B"), "doc_id", F.lit(" was rejected. "), "text")).otherwise(F.col("text"))
    return d.select("doc_id", decision_excerpt(text).alias("excerpt")).where("excerpt IS NOT NULL")


@query(f"WITH {CODE_SQL} SELECT 'm' || a.p AS memory_id, b.id AS symbol_id FROM symbol a JOIN symbol b ON b.file_path = a.file_path AND b.start_line BETWEEN a.start_line AND a.end_line WHERE a.p % 3 = 0")
def span_links_of_notes(spark, sf_dir):
    s = code_graph(spark, sf_dir)["symbol"]
    ref = F.format_string("%s#L%d-L%d", "file_path", "start_line", "end_line")
    return span_links(s.where("p % 3 = 0").select(F.concat(F.lit("m"), "p").alias("id"), ref.alias("source_ref")), s, 1).select("memory_id", "symbol_id")


@query(f"WITH {CODE_SQL}, f AS (SELECT min(file_path) AS f FROM symbol), r AS (SELECT id, end_line - start_line AS n FROM symbol, f WHERE file_path = f AND 12 BETWEEN start_line AND end_line) SELECT id AS symbol_id, 1.0::DOUBLE AS weight FROM r ORDER BY n, id LIMIT 1")
def note_links(spark, sf_dir):
    s = code_graph(spark, sf_dir)["symbol"]
    first = s.agg(F.min("file_path")).first()[0]
    return write_note(spark.createDataFrame([], MEMORY), s, layer="semantic", title="t", body="b", source_ref=f"{first}#L12-L13", now_ms=5)[1].select("symbol_id", "weight")


@query(f"WITH {POSTINGS_SQL}, left_over AS (SELECT * FROM post WHERE node_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr')) SELECT term, count(*) AS df FROM left_over GROUP BY 1")
def index_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("node_id"))
    return document_frequency(remove_documents(postings(_terms(spark, sf_dir)), gone))


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN source || ' / ' || lang || ' > ' || n_chars WHEN doc_id % 2 = 0 THEN 'd' || doc_id || '.md (1/3)' ELSE 'd' || doc_id || '.md' END AS title FROM documents""")
def chunk_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/d"), "doc_id", F.lit(".md"))
    heads = F.when(F.col("lang") == "en", F.array("lang", F.col("n_chars").cast("string"))).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", title_for(path, heads, F.lit(1), F.when(F.col("doc_id") % 2 == 0, 3).otherwise(1)).alias("title"))


CJK_DIGITS = "零一二三四五六七八九"


@query(f"""WITH c AS (SELECT doc_id, translate(CAST(doc_id + 10 AS VARCHAR), '0123456789', '{CJK_DIGITS}') AS run FROM documents) SELECT doc_id, array_to_string(list_transform(generate_series(1, length(run) - 1), lambda i: substring(run, CAST(i AS INT), 2)), ' ') AS terms FROM c""")
def cjk_terms(spark, sf_dir):
    run = F.translate((F.col("doc_id") + 10).cast("string"), "0123456789", CJK_DIGITS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokenize(run), " ").alias("terms"))


class Lengths:
    """A provider whose vectors tell the length of a text."""

    space = Space("lengths", 2, "local")

    def warmup(self):
        pass

    def embed(self, texts):
        return np.array([[len(t), 1.0] for t in texts], dtype=np.float32).tolist()


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS length FROM documents WHERE lang <> 'en'")
def provider_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    same = F.col("lang") == "en"
    known = {"embedding_model": F.when(same, "lengths"), "embedding_dims": F.when(same, 2), "embedding_provider": F.when(same, "local"), "embedding": F.when(same, F.array(F.lit(0.0)))}
    return to_embed(d.withColumns(known), Lengths.space).select("doc_id", with_provider(F.col("text"), Lengths())[0].cast("double").alias("length"))


@query("""WITH w AS (SELECT 'constraints.md' AS path, 'Constraints' AS title, '- ' || c_name || ' (f' || c_nationkey || ')' AS line FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'incidents.md', 'Incidents', '- ' || c_name || ' (f' || c_nationkey || ')' FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
UNION ALL SELECT 'modules.md', 'Modules', '- src/m' || n_regionkey || ': ' || count(*) || ' declarations in ' || count(DISTINCT n_nationkey % 2) || ' files' FROM nation GROUP BY n_regionkey),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM w) SELECT path, '# ' || any_value(title) || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n) AS body FROM r WHERE n <= 200 GROUP BY path
UNION ALL SELECT * FROM (VALUES ('flows.md', '# Flows' || chr(10) || chr(10)), ('routes.md', '# Routes' || chr(10) || chr(10)), ('structure.md', '# Structure' || chr(10) || chr(10))) t(path, body)""")
def wiki_pages(spark, sf_dir):
    rows = _memory(spark, sf_dir).withColumn("title", F.split("title", " ")[0])
    n = table(spark, sf_dir, "nation")
    symbol = n.select(F.concat(F.lit("s"), "n_nationkey").alias("id"), F.concat(F.lit("src/m"), "n_regionkey", F.lit("/f"), (F.col("n_nationkey") % 2).cast("string"), F.lit(".ts")).alias("file_path"))
    empty = lambda s: spark.createDataFrame([], s)
    return reports.wiki_pages(rows, symbol, empty("process_id string, depth int"), empty("files array<string>"), empty("method string, path string, file_path string"), empty("name string, size long"))


LINK_TYPES = ("RESOLVES", "CONTRADICTS", "SUPERSEDES")


@query(f"""WITH {MEMORY_SQL}, {LINKS_SQL}, typed AS (SELECT src, dst, CASE CAST(substring(src, 2) AS INT) % 3 WHEN 0 THEN 'RESOLVES' WHEN 1 THEN 'CONTRADICTS' ELSE 'SUPERSEDES' END AS type FROM links)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, 'declared' AS kind FROM typed WHERE type = 'CONTRADICTS'""")
def declared_conflicts(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in LINK_TYPES]), (F.substring("src", 2, 20).cast("int") % 3 + 1).cast("int"))
    return memory.conflicts(_memory(spark, sf_dir), _links(spark, sf_dir).withColumn("type", kind), threshold=1.0).where("kind = 'declared'").select("a", "b", "kind")


@query("""WITH t AS (SELECT c_custkey AS id, 'fix ' || lower(n_name) || ' ' || c_mktsegment AS title FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 4 = 0), p AS (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.title = y.title AND x.id < y.id)
SELECT a, b FROM p WHERE b <> a + 4""")
def conflicts_but_linked(spark, sf_dir):
    """Titles that are equal, but for pairs that a link already explains."""
    c, n = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0"), table(spark, sf_dir, "nation")
    rows = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.lit("semantic").alias("layer"), F.concat_ws(" ", F.lit("fix"), F.lower("n_name"), "c_mktsegment").alias("title"), F.lit(None).cast("long").alias("superseded_at"))
    links = rows.select((F.col("id") + 4).alias("src"), F.col("id").alias("dst"), F.lit("SUPERSEDES").alias("type"))
    return memory.conflicts(rows, links, threshold=1.0).where("kind = 'suspected'").select("a", "b")


@query("""WITH t AS (SELECT c_custkey AS id, 'fix ' || lower(n_name) || ' ' || c_mktsegment AS title FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 4 = 0), k AS (SELECT title, min(id) AS rep, count(*) AS n FROM t GROUP BY 1),
e AS (SELECT k.rep, count(*) AS explained FROM t x JOIN t y ON y.id = x.id + 4 AND x.title = y.title JOIN k ON k.title = x.title GROUP BY 1)
SELECT k.rep AS a, k.rep AS b, 1.0::DOUBLE AS similarity, n * (n - 1) // 2 AS pairs, coalesce(explained, 0) AS explained, md5(string_agg(t.id::VARCHAR, ',' ORDER BY t.id)) AS members FROM k LEFT JOIN e ON e.rep = k.rep JOIN t ON t.title = k.title WHERE n > 1 GROUP BY k.rep, n, explained""")
def conflict_classes(spark, sf_dir):
    """Classes of equal titles, how many pairs they stand for, and how many of these an edge explains."""
    c, n = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0"), table(spark, sf_dir, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.lit("semantic").alias("layer"), F.concat_ws(" ", F.lit("fix"), F.lower("n_name"), "c_mktsegment").alias("title"), F.lit(None).cast("long").alias("superseded_at"))
    links = rows.select((F.col("id") + 4).alias("src"), F.col("id").alias("dst"), F.lit("SUPERSEDES").alias("type"))
    members, found = memory.conflict_classes(rows, links, threshold=1.0)
    held = members.groupBy(F.col("rep").alias("a")).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",")).alias("members"))
    return found.join(held, "a")
