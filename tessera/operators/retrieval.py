"""Ranked retrieval: semantic, recency, entity and graph branches, fusion, paging, evaluation.

Every frame carries ``query_id``, so a batch of questions is one program.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.paths import canonical_path, is_path
from tessera.functions.scores import clamp_distance, decay, wilson
from tessera.functions.text import snippet, tokenize
from tessera.model import DAY_MS
from tessera.operators.index import bm25, for_questions, query_terms, term_overlap, top
from tessera.operators.ranking import ranked
from tessera.result import Result, report
from tessera.session import keep, spread

RRF_K = 60


def live(memory: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """Rows that nothing superseded, of the given layers."""
    rows = memory.where("superseded_at IS NULL")
    return rows.where(F.col("layer").isin(layers)) if layers else rows


def same_space(memory: DataFrame, model: str, dims: int, provider: str) -> DataFrame:
    """Rows whose vector lies in the space named; others can't be compared."""
    return memory.where((F.col("embedding_model") == model) & (F.col("embedding_dims") == dims) & (F.col("embedding_provider") == provider))


def semantic_top(vectors: DataFrame, queries: DataFrame, limit: int = 20, max_distance: float | None = None, id_col: str = "id", block: int = 4096) -> DataFrame:
    """query_id, node_id, similarity, distance, rank by exact cosine, within a distance, ties to the smaller id.

    Questions go to the workers as matrices of one width and at most ``block`` rows; each batch of vectors is one product with it and sends its
    ``limit`` best per question. More questions are more such passes, each kept before the next, so that only one matrix is held at a time.
    Vectors of another width never match.
    """
    bound = clamp_distance(max_distance)
    node_type, query_type = dict(vectors.dtypes)[id_col], dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    sizes = sorted((r.w, r.n) for r in asked.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).collect())
    sized = vectors.select(F.col(id_col).alias("node_id"), "embedding")
    schema = f"query_id {query_type}, node_id {node_type}, similarity double, distance double, rank int"
    parts = [(w, -(-n // block), i) for w, n in sizes for i in range(-(-n // block))]
    out = vectors.sparkSession.createDataFrame([], schema)
    for width, of, i in parts:
        some = asked.where((F.size("embedding") == width) & (F.pmod(F.xxhash64("query_id"), F.lit(of)) == i)).collect()
        near = _products(sized.where(F.size("embedding") == width), [r.query_id for r in some], _unit(np.array([r.embedding for r in some], dtype=np.float64).reshape(len(some), width)), limit, f"query_id {query_type}, node_id {node_type}, similarity double")
        near = near.withColumn("distance", F.round(1 - F.col("similarity"), 5)).where(F.col("distance") <= bound)
        part = top(near.select("query_id", "node_id", "similarity", "distance"), "query_id", limit, F.asc("distance"), F.asc("node_id"))
        if len(parts) == 1:
            return part
        out = out.unionByName(keep(part, "similar"))
    return out


#: Similarities a worker holds at a time.
AT_ONCE = 1 << 21


def _products(vectors: DataFrame, names: list, matrix: np.ndarray, limit: int, schema: str) -> DataFrame:
    """Each task's ``limit`` most similar vectors to each row of a matrix, over all cores. A worker holds ``AT_ONCE`` similarities and the best so far, whatever the size of a batch."""
    rows = max(1, AT_ONCE // max(1, len(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, best = np.full(len(names), -np.inf), None
        for batch in batches:
            for at in range(0, len(batch), rows):
                some = batch.iloc[at : at + rows]
                s = _unit(np.stack(some["embedding"].to_numpy()).astype(np.float64)) @ matrix.T
                if np.isneginf(least).any():
                    s[np.isnan(s)] = -np.inf
                if best is None and len(s) > limit:
                    least = np.maximum(least, np.round(np.partition(s, len(s) - limit, axis=0)[len(s) - limit], 5))
                # rounding moves a similarity by less than 1e-5, so only what comes that near to the best so far is rounded
                i, k = np.nonzero(s >= least - 1e-5)
                near = np.round(s[i, k], 5)
                high = near >= least[k]
                i, k, near = i[high], k[high], near[high]
                ids = some["node_id"].to_numpy()[i]
                if best is not None:
                    k, near, ids = np.append(best[0], k), np.append(best[1], near), np.append(best[2], ids)
                order = np.lexsort((ids, -near, k))
                k = k[order]
                place = np.arange(len(k)) - np.searchsorted(k, k)
                first = order[place < limit]
                best = k[place < limit], near[first], ids[first]
                last = place == limit - 1
                least[k[last]] = np.maximum(least[k[last]], near[order[last]])
        if best is not None:
            for at in range(0, len(best[0]), 65_536):
                k, near, ids = (x[at : at + 65_536] for x in best)
                yield pd.DataFrame({"query_id": [names[j] for j in k], "node_id": ids, "similarity": near})

    return spread(vectors).mapInPandas(run, schema)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; a zero row stays, so that its similarity is 0."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def recency_rank(candidates: DataFrame, now_ms: Column, limit: int = 20) -> DataFrame:
    """Rank by coverage * importance * decay; needs query_id, node_id, coverage, importance, layer, created_at."""
    score = F.round(F.col("coverage") * F.coalesce(F.nullif("importance", F.lit(0.0)), F.lit(1.0)) * decay(F.col("layer"), F.col("created_at"), now_ms), 6)
    return top(candidates.withColumn("score", score), "query_id", limit, F.desc("score"), F.asc("node_id"))


def entity_rank(asked: DataFrame, memory: DataFrame, about: DataFrame, symbol: DataFrame, calls: DataFrame, limit: int = 10) -> DataFrame:
    """Memories about a symbol the question names, then about symbols one call away.

    ``asked`` has query_id and term. A memory reached twice keeps its better place.
    """
    named = symbol.withColumn("term", F.lower("name")).join(F.broadcast(asked), "term").select("query_id", F.col("id").alias("symbol_id")).distinct()
    steps = calls.select(F.col("src").alias("symbol_id"), F.col("dst").alias("next")).union(calls.select("dst", "src")).distinct()
    beyond = named.join(steps, "symbol_id").select("query_id", F.col("next").alias("symbol_id")).distinct()
    reached = named.withColumn("via", F.lit(0)).unionByName(beyond.withColumn("via", F.lit(1)))
    facts = memory.select(F.col("id").alias("memory_id"), "importance", "created_at")
    found = reached.join(about.select("memory_id", "symbol_id"), "symbol_id").groupBy("query_id", "memory_id").agg(F.min("via").alias("via")).join(facts, "memory_id")
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy("query_id", "via").orderBy(F.desc("importance"), F.desc("created_at"), "memory_id")))
    kept = ranked.where(F.col("place") <= F.when(F.col("via") == 0, 2 * limit).otherwise(limit))
    order = W.partitionBy("query_id").orderBy("via", "place")
    return kept.select("query_id", F.col("memory_id").alias("node_id"), "via", F.row_number().over(order).alias("rank"))


def graph_rank(seeds: DataFrame, edges: DataFrame, eligible: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Neighbours of the seeds over undirected edges, without the seeds, by how many edges reach them."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    reached = seeds.select("query_id", F.col("node_id").alias("src")).distinct().join(both, "src").groupBy("query_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("support"))
    fresh = reached.join(seeds.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    if eligible is not None:
        fresh = fresh.join(eligible.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return top(fresh, "query_id", 2 * limit, F.desc("support"), F.asc("node_id"))


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of query_id, branch, node_id, rank: score, the rank in each branch, and the fused rank."""
    one = ranked.groupBy("query_id", "node_id", "branch").agg(F.min("rank").alias("rank"))
    hits = one.groupBy("query_id", "node_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", "rank")))).alias("ranks"))
    return hits.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node_id")))


def page(fused: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """A window of the fused ranking with how many there are and how many the window leaves out."""
    total = F.count("*").over(W.partitionBy("query_id"))
    kept = fused.withColumn("total", total).where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return kept.withColumn("omitted", F.greatest(F.lit(0), F.col("total") - offset - limit))


def search(
    memory: DataFrame,
    queries: DataFrame,
    *,
    edges: DataFrame | None = None,
    about: DataFrame | None = None,
    symbol: DataFrame | None = None,
    calls: DataFrame | None = None,
    limit: int = 10,
    offset: int = 0,
    layers: list[str] | None = None,
    max_distance: float = 0.75,
    stale_after_days: int = 180,
    disable: tuple[str, ...] = (),
    now_ms: Column | None = None,
    snippets: bool = True,
) -> Result:
    """Five branches, fused, paged, and only then joined to whole rows.

    ``queries`` has query_id and text, and embedding (with the space in embedding_model, embedding_dims,
    embedding_provider on the memory side already filtered) where the semantic branch is to run.
    """
    spark = memory.sparkSession
    now = F.lit(0) if now_ms is None else now_ms
    rows = live(memory, layers)
    post, stats = for_questions(rows.select("id", F.concat_ws("\n", "title", "body").alias("text")), queries)
    unavailable: dict[str, str] = {b: "disabled" for b in disable}
    branches: dict[str, DataFrame] = {}

    if "bm25" not in disable:
        branches["bm25"] = bm25(post, stats, queries, 3 * limit)
    if "semantic" not in disable:
        if "embedding" in queries.columns:
            branches["semantic"] = semantic_top(rows.where("embedding IS NOT NULL"), queries, 3 * limit, max_distance)
        else:
            unavailable["semantic"] = "no query vectors"
    if "recency" not in disable:
        n = queries.select("query_id", F.size(F.array_distinct(tokenize(F.col("text")))).alias("n"))
        shared = term_overlap(post, queries, 6 * limit).join(F.broadcast(n), "query_id").withColumn("coverage", F.col("overlap") / F.col("n"))
        branches["recency"] = recency_rank(shared.select("query_id", "node_id", "coverage").join(rows.select(F.col("id").alias("node_id"), "importance", "layer", "created_at"), "node_id"), now, 3 * limit)
    if "entity" not in disable:
        if about is not None and symbol is not None and calls is not None:
            words = queries.select("query_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("term")).where("term <> ''")
            asked = words.union(query_terms(queries)).distinct()
            branches["entity"] = entity_rank(asked, rows, about, symbol, calls, limit)
        else:
            unavailable["entity"] = "no code graph"
    shown = {b: df.select("query_id", F.lit(b).alias("branch"), "node_id", "rank") for b, df in branches.items()}
    schema = "query_id string, branch string, node_id string, rank int"
    ranked = spark.createDataFrame([], schema)
    for df in shown.values():
        ranked = ranked.unionByName(df.select(F.col("query_id").cast("string").alias("query_id"), "branch", "node_id", "rank"))
    if "graph" not in disable:
        if edges is not None:
            seeds = ranked.where(F.col("rank") <= max(3, -(-limit // 2)))
            ranked = ranked.unionByName(graph_rank(seeds, edges, rows, limit).select("query_id", F.lit("graph").alias("branch"), "node_id", "rank"))
        else:
            unavailable["graph"] = "no edges"

    hits = page(fuse(ranked), limit, offset)
    whole = hits.join(rows.withColumnRenamed("id", "node_id"), "node_id")
    stale = (now - F.col("created_at")) > stale_after_days * DAY_MS
    out = whole.select("query_id", "place", "node_id", "layer", "title", "source_ref", "score", "ranks", "total", "omitted", stale.alias("stale"), *(["body"] if snippets else []))
    if snippets:
        asked = queries.select(F.col("query_id").cast("string").alias("query_id"), tokenize(F.col("text")).alias("asked"))
        out = out.join(F.broadcast(asked), "query_id").withColumn("snippet", snippet(F.col("body"), F.col("asked"))).drop("body", "asked")
    return Result(out, report(spark, ranked, ["bm25", "semantic", "recency", "entity", "graph"], unavailable))


def index(memory: DataFrame, queries: DataFrame, limit: int = 30, **options) -> Result:
    """A search that lists titles only."""
    return search(memory, queries, limit=limit, snippets=False, **options)


def path_anchor(memory: DataFrame, path: str) -> DataFrame:
    """Memories recorded against a path: its own, one ending in it, or one whose source names it."""
    ends, starts, within = "/" + path, path + "#", "/" + path
    return memory.where((F.col("file_path") == path) | F.col("file_path").endswith(ends) | F.col("source_ref").startswith(starts) | F.col("source_ref").contains(within))


def why(memory: DataFrame, target: str, *, about: DataFrame | None = None, symbol: DataFrame | None = None, queries: DataFrame | None = None, limit: int = 10, anchor_only: bool = False, **options) -> Result:
    """What is anchored on a path or a name leads, by layer and importance; text search over the reasoning layers follows."""
    spark = memory.sparkSession
    rows = live(memory)
    path = bool(spark.range(1).select(is_path(F.lit(target)).alias("p")).first().p)
    if path:
        unified = spark.range(1).select(canonical_path(F.lit(target)).alias("p")).first().p
        anchored = path_anchor(rows, unified)
    elif about is not None and symbol is not None:
        named = symbol.where(F.lower("name") == target.lower()).select(F.col("id").alias("symbol_id"))
        anchored = rows.join(about.join(F.broadcast(named), "symbol_id").select(F.col("memory_id").alias("id")).distinct(), "id", "left_semi")
    else:
        anchored = rows.limit(0)
    order = F.when(F.col("layer") == "semantic", 0).when(F.col("layer") == "episodic", 1).when(F.col("layer") == "procedural", 2).otherwise(3)
    placed = ranked(anchored.select("id", "layer", "title", "source_ref", "importance"), [order, F.desc("importance"), F.asc("id")], "first").where(F.col("first") <= limit)
    lead = placed.select(F.lit("0").alias("query_id"), F.col("id").alias("node_id"), "layer", "title", "source_ref", F.col("first").cast("int").alias("rank"))
    if anchor_only:
        return Result(lead.withColumn("anchored", F.lit(True)), report(spark, lead.withColumn("branch", F.lit("anchor")), ["anchor"]))
    asked = queries if queries is not None else spark.createDataFrame([("0", target)], "query_id string, text string")
    found = search(memory, asked, limit=limit, layers=["semantic", "episodic", "procedural"], **options)
    rest = found.rows.join(lead.select("node_id"), "node_id", "left_anti").select("query_id", "node_id", "layer", "title", "source_ref", (F.col("place") + 1_000_000).alias("rank"))
    both = lead.withColumn("anchored", F.lit(True)).unionByName(rest.withColumn("anchored", F.lit(False)))
    out = both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= limit)
    return Result(out, found.report.unionByName(report(spark, lead.withColumn("branch", F.lit("anchor")), ["anchor"])))


def get(memory: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """A node and its edges either way."""
    return memory.where(F.col("id") == node), edges.where((F.col("src") == node) | (F.col("dst") == node))


def nearby(memory: DataFrame, queries: DataFrame, least: float = 0.55, keep_n: int = 3) -> DataFrame:
    """Suggestions beside a new note: the closest reasoning rows, never linked by themselves."""
    near = semantic_top(live(memory, ["semantic", "episodic", "procedural"]).where("embedding IS NOT NULL"), queries, 6, 2.0)
    return near.where(F.col("similarity") >= least).where(F.col("rank") <= keep_n)


def token_budget(rows: DataFrame, text: str, budget: int, by: str, order: list[str]) -> DataFrame:
    """The prefix of each group that fits a token budget of ceil(length / 4) each; the first row always does."""
    w = W.partitionBy(by).orderBy(*order)
    counted = rows.withColumn("tokens", F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long"))
    counted = counted.withColumn("used", F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w))
    return counted.where((F.col("rn") == 1) | (F.col("used") <= budget))


def tiered_budget(rows: DataFrame, tier: Column, order: list[Column], budget: int) -> DataFrame:
    """The first ``budget`` rows by tier and order, with how many of each tier are left out."""
    numbered = ranked(rows.withColumn("tier", tier), [F.asc("tier"), *order], "rn")
    left = numbered.groupBy("tier").agg(F.count_if(F.col("rn") > budget).alias("omitted"))
    return numbered.where(F.col("rn") <= budget).join(left, "tier")


def evaluate(answers: DataFrame, questions: DataFrame, top_k: int = 5) -> DataFrame:
    """config, asked, found, recall, false_hits and the Wilson interval.

    ``answers`` has config, query_id, rank, text; ``questions`` query_id, expect and reject (arrays of fragments).
    """
    shown = answers.where(F.col("rank") <= top_k).join(questions, "query_id").groupBy("config", "query_id").agg(
        F.max(F.exists("expect", lambda e: F.contains(F.lower("text"), F.lower(e)))).alias("hit"), F.max(F.exists("reject", lambda e: F.contains(F.lower("text"), F.lower(e)))).alias("wrong")
    )
    every = answers.select("config").distinct().crossJoin(F.broadcast(questions.select("query_id")))
    per = every.join(shown, ["config", "query_id"], "left").groupBy("config").agg(F.count("*").alias("asked"), F.count_if("hit").alias("found"), F.count_if("wrong").alias("false_hits"))
    bounds = wilson(F.col("found"), F.col("asked"))
    return per.select("config", "asked", "found", F.round(F.col("found") / F.col("asked"), 4).alias("recall"), "false_hits", bounds["low"].alias("low"), bounds["high"].alias("high"))
