"""Sinks for people: viewer payload, wiki pages and their drift, maps, budgeted JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.paths import mermaid_quote, module_of, qualified_name
from tessera.operators.retrieval import tiered_budget
from tessera.session import replace_text

NODE_BUDGET, LIST_BUDGET, PREVIEW, JSON_BYTES = 3000, 2000, 600, 24_000


def viewer_nodes(memory: DataFrame, edges: DataFrame, budget: int = NODE_BUDGET) -> DataFrame:
    """id, layer, title, preview, tier, degree, omitted: what a viewer shows: connected reasoning, then other reasoning, then artifacts."""
    degree = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    rows = memory.where("superseded_at IS NULL").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    tier = F.when((F.col("layer") != "artifact") & (F.col("degree") > 0), 0).when(F.col("layer") != "artifact", 1).when(F.col("degree") > 0, 2).otherwise(3)
    kept = tiered_budget(rows, tier, [F.desc("degree"), F.desc("importance"), F.asc("id")], budget)
    return kept.select("id", "layer", "title", F.substring("body", 1, PREVIEW).alias("preview"), "tier", "degree", "omitted")


def viewer_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends shown."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def viewer_html(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A page with the payload inside; the budget bounds what comes to the driver."""
    payload = json.dumps({"nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in edges.limit(10 * NODE_BUDGET).collect()]}, default=str).replace("</", "<\\/")
    page = f'<!doctype html><meta charset="utf-8"><title>memory</title><pre id="out"></pre><script type="application/json" id="data">{payload}</script><script>const d=JSON.parse(document.getElementById("data").textContent);document.getElementById("out").textContent=d.nodes.map(n=>n.layer+"\\t"+n.title).join("\\n")</script>'
    replace_text(nodes.sparkSession, path, page)


def wiki_pages(memory: DataFrame, symbol: DataFrame, flows: DataFrame, cycles: DataFrame, routes: DataFrame, clusters: DataFrame, per_page: int = 200) -> DataFrame:
    """path, body: six pages derived from the tables, each line in a fixed order."""

    def page(name: str, title: str, lines: DataFrame) -> DataFrame:
        kept = lines.where("line IS NOT NULL").orderBy("line").limit(per_page)
        return kept.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines")).select(F.lit(name).alias("path"), F.concat(F.lit(f"# {title}\n\n"), "lines").alias("body"))

    live = memory.where("superseded_at IS NULL")
    parts = [
        page("constraints.md", "Constraints", live.where("layer = 'semantic'").select(F.concat(F.lit("- "), "title", F.lit(" ("), "source_ref", F.lit(")")).alias("line"))),
        page("incidents.md", "Incidents", live.where("layer = 'episodic'").select(F.concat(F.lit("- "), "title", F.lit(" ("), "source_ref", F.lit(")")).alias("line"))),
        page("modules.md", "Modules", symbol.groupBy(module_of(F.col("file_path")).alias("m")).agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("f")).select(F.format_string("- %s: %d declarations in %d files", "m", "n", "f").alias("line"))),
        page("flows.md", "Flows", flows.groupBy("process_id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).select(F.format_string("- %s: %d steps, depth %d", qualified_name(F.col("process_id")), "n", "d").alias("line"))),
        page("routes.md", "Routes", routes.select(F.concat(F.lit("- "), "method", F.lit(" "), F.coalesce("path", F.lit("(variable)")), F.lit(" in "), "file_path").alias("line"))),
        page("structure.md", "Structure", cycles.select(F.concat(F.lit("- cycle: "), F.array_join("files", ", ")).alias("line")).unionByName(clusters.select(F.concat(F.lit("- cluster "), "name", F.lit(": "), F.col("size").cast("string")).alias("line")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wiki_drift(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """path, state: missing, extra, changed or current, whatever the provenance footer says."""
    bare = lambda c: F.regexp_replace(c, r"(?s)\n*<!-- provenance.*$", "")
    both = pages.select("path", bare(F.col("body")).alias("new")).join(existing.select("path", bare(F.col("body")).alias("old")), "path", "full_outer")
    return both.select("path", F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "extra").when(F.col("old") != F.col("new"), "changed").otherwise("current").alias("state"))


def mermaid(symbol: DataFrame, calls: DataFrame, most: int = 100) -> DataFrame:
    """line: a call graph as text, edges in order."""
    a = F.concat(F.lit('["'), mermaid_quote(qualified_name(F.col("src"))), F.lit('"]'))
    b = F.concat(F.lit('["'), mermaid_quote(qualified_name(F.col("dst"))), F.lit('"]'))
    node = lambda c: F.concat(F.lit("n"), F.substring(F.sha1(F.col(c)), 1, 8))
    return calls.select("src", "dst").distinct().orderBy("src", "dst").limit(most).select(F.concat(F.lit("  "), node("src"), a, F.lit(" --> "), node("dst"), b).alias("line"))


def budgeted_json(rows: DataFrame, by: str, order: list[str], most: int = JSON_BYTES) -> DataFrame:
    """The prefix of each group whose rows as JSON fit a number of bytes, with how many are cut."""
    w = W.partitionBy(by).orderBy(*order)
    text = F.to_json(F.struct(*rows.columns))
    sized = rows.withColumn("json", text).withColumn("bytes", F.sum(F.octet_length("json") + 1).over(w.rowsBetween(W.unboundedPreceding, 0)))
    total = F.count("*").over(W.partitionBy(by))
    kept = sized.withColumn("total", total).where(F.col("bytes") <= most)
    return kept.withColumn("omitted", F.col("total") - F.count("*").over(W.partitionBy(by)))
