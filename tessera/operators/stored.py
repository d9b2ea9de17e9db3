"""The inverted index as tables: postings in bucketed blocks with bounds, read by searches that never see a text.

Three tables. ``blocks`` has a row for each term and segment of documents: the postings as arrays, and the greatest term frequency and least
length among them, which bound every weight in the block whatever the corpus becomes. It is bucketed and sorted by term and segment, so
that a search joins it where it lies. ``changes`` has what each generation added to or took from a term's document frequency;
``documents`` the documents of each generation, with the terms that a later removal has to take back.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scores import bm25_weight, idf
from tessera.operators.index import query_terms, terms_of, top
from tessera.session import keep, shared_dir

#: A bound is compared with scores rounded to six places, of weights rounded to nine.
SLACK = 1e-5


@dataclass(frozen=True)
class StoredIndex:
    """Where an index lies. ``id_type`` is that of the documents' ids."""

    spark: SparkSession
    path: str
    name: str
    id_type: str
    buckets: int

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    @property
    def generation(self) -> int:
        """How many changes the index has had."""
        return (self.table("documents").agg(F.max("generation")).first()[0] or 0) if self.table("documents").take(1) else 0


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = 32) -> StoredIndex:
    """The index at ``path``, made if there is none. Its tables are told to the session; the files are all there is to keep."""
    out = StoredIndex(spark, path, f"stored_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}", id_type, buckets)
    for kind, columns, by in (
        ("blocks", f"term STRING, segment BIGINT, n INT, max_tf INT, min_len INT, ids ARRAY<{id_type}>, tfs ARRAY<INT>, lens ARRAY<INT>", "term, segment"),
        ("changes", "term STRING, n BIGINT, generation INT", "term"),
        ("documents", f"node_id {id_type}, doc_len INT, terms ARRAY<STRING>, generation INT, here BOOLEAN", "node_id"),
    ):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {out.name}_{kind} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/{kind}'")
    return out


def temporary_index(spark: SparkSession, **options: object) -> StoredIndex:
    return open_index(spark, f"{shared_dir(spark)}/tessera/index-{uuid.uuid4().hex}", **options)


def _insert(index: StoredIndex, kind: str, rows: DataFrame, *by: str) -> None:
    """Each task's rows go to the files of their buckets from where they lie; ``by`` brings those of a bucket together first, which is for few rows."""
    (rows.repartition(index.buckets, *by) if by else rows).write.insertInto(f"{index.name}_{kind}")


def add_documents(index: StoredIndex, docs: DataFrame, id_col: str = "id", text_col: str = "text", segment_docs: int = 1024) -> None:
    """Index documents that are not in it. Texts are read once; what was there before is neither read nor written.

    Documents fall into segments of about ``segment_docs`` by a hash of their id, so a block is short however common its term. One writer at a time. Null ids
    are left out, of a repeated id one row counts, a null text has no terms.
    """
    now = index.generation + 1
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(index.id_type).alias("node_id"), F.col(text_col).alias("text"))
    # texts travel only where an id is repeated
    twice = keep(rows.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select("node_id"), "twice")
    if not twice.isEmpty():
        rows = rows.join(twice, "node_id", "left_anti").unionByName(rows.join(twice, "node_id", "left_semi").groupBy("node_id").agg(F.min("text").alias("text")))
    terms = keep(terms_of(rows, "node_id", "text"), "terms")
    segments = max(1, -(-terms.count() // segment_docs))
    segment = F.lit(now).cast("bigint") * F.lit(1 << 32) + F.pmod(F.xxhash64("node_id", F.lit(3)), F.lit(segments))
    # documents are dealt by segment as whole rows; a segment's blocks are then made where it lies
    each = terms.withColumn("segment", segment).repartition("segment").select("node_id", "doc_len", "segment", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("node_id", F.col("doc_len").cast("int").alias("doc_len"), "segment", F.col("p.terms").alias("term"), F.col("p.tfs").cast("int").alias("tf"))
    held = F.array_sort(F.collect_list(F.struct("node_id", "tf", "doc_len")))
    blocks = each.groupBy("term", "segment").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), held.alias("h"))
    _insert(index, "blocks", blocks.select("term", "segment", "n", "max_tf", "min_len", F.col("h.node_id").alias("ids"), F.col("h.tf").alias("tfs"), F.col("h.doc_len").alias("lens")))
    added = index.table("blocks").where(F.col("segment") >= F.lit(now).cast("bigint") * F.lit(1 << 32)).select("term", "n")
    _insert(index, "changes", added.groupBy("term").agg(F.sum("n").alias("n")).withColumn("generation", F.lit(now)), "term")
    _insert(index, "documents", terms.select("node_id", F.col("doc_len").cast("int"), "terms", F.lit(now).alias("generation"), F.lit(True).alias("here")))


def current(index: StoredIndex, *columns: str) -> DataFrame:
    """The documents of the index: for each id its last row, if that is one that adds it."""
    last = index.table("documents").groupBy("node_id").agg(F.max_by(F.struct(*columns, "generation", "here"), F.struct("generation", "here")).alias("r"))
    return last.where("r.here").select("node_id", *(f"r.{c}" for c in columns), "r.generation")


def remove_documents(index: StoredIndex, gone: DataFrame, id_col: str = "id") -> None:
    """Take documents out: a row for each and what their terms lose. No block is touched; searches pass over their postings. Ids that are not there are ignored."""
    ids = gone.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(index.id_type).alias("node_id")).distinct()
    now = index.generation + 1
    dead = keep(current(index, "doc_len", "terms").join(ids, "node_id", "left_semi"), "dead")
    _insert(index, "changes", dead.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("n")).withColumn("generation", F.lit(now)), "term")
    _insert(index, "documents", dead.select("node_id", "doc_len", "terms", F.lit(now).alias("generation"), F.lit(False).alias("here")), "node_id")


def replace_documents(index: StoredIndex, docs: DataFrame, id_col: str = "id", text_col: str = "text", segment_docs: int = 1024) -> None:
    """Documents that are there with another text, and new ones."""
    remove_documents(index, docs, id_col)
    add_documents(index, docs, id_col, text_col, segment_docs)


def stats_of(index: StoredIndex) -> DataFrame:
    """doc_count and total_length: sums over all generations, without a look at any document's terms."""
    sign = F.when(F.col("here"), 1).otherwise(-1)
    return index.table("documents").agg(F.coalesce(F.sum(sign), F.lit(0)).alias("doc_count"), F.coalesce(F.sum(sign * F.col("doc_len")), F.lit(0)).cast("long").alias("total_length"))


def _weight(tf: Column, length: Column) -> Column:
    return idf(F.col("doc_count"), F.col("df")) * bm25_weight(tf, length, F.col("total_length") / F.col("doc_count"))


def _asked(index: StoredIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, df and the corpus statistics, of terms that occur."""
    terms = query_terms(queries)
    frequency = index.table("changes").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
    return terms.join(frequency, "term").crossJoin(F.broadcast(stats_of(index)))  # one row


def bounds(index: StoredIndex, asked: DataFrame) -> DataFrame:
    """query_id, segment, bound, n: the most that any document of a segment can score. Reads the blocks' heads, not their postings."""
    heads = index.table("blocks").select("term", "segment", "n", "max_tf", "min_len").join(asked, "term")
    return heads.groupBy("query_id", "segment").agg((F.sum(_weight(F.col("max_tf"), F.col("min_len"))) + SLACK).alias("bound"), F.max("n").alias("n"))


def scores(index: StoredIndex, asked: DataFrame, segments: DataFrame) -> DataFrame:
    """query_id, node_id, score, matched, of the segments (query_id, segment) alone. Blocks are joined where they lie."""
    wanted = asked.join(segments.select("query_id", "segment"), "query_id")
    hits = index.table("blocks").select("term", "segment", "ids", "tfs", "lens").join(wanted, ["term", "segment"])
    each = hits.select("query_id", "term", "segment", "df", "doc_count", "total_length", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
    each = each.select("query_id", "term", F.shiftright("segment", 32).cast("int").alias("generation"), F.col("p.ids").alias("node_id"), F.round(_weight(F.col("p.tfs"), F.col("p.lens")), 9).alias("w"))
    removed = index.table("documents").where("NOT here")
    if removed.take(1):
        left = removed.groupBy("node_id").agg(F.max("generation").alias("until"))
        each = each.join(left, "node_id", "left").where("until IS NULL OR generation > until")
    return each.groupBy("query_id", "node_id").agg(F.round(F.sum("w"), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))


def search(index: StoredIndex, queries: DataFrame, limit: int = 20, probe: int = 4) -> DataFrame:
    """query_id, node_id, score, matched, rank, as ``index.bm25`` over the same documents; ties to the smaller id.

    First the ``probe`` segments of the highest bounds are scored for each question. Where they hold ``limit`` documents, the last of these is a score that
    the answer can't be below, and segments that can't reach it are passed over: their postings are not read into the join. No text is read.
    """
    asked = keep(_asked(index, queries), "asked")
    found = keep(bounds(index, asked), "bounds")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "segment"))
    first = keep(found.withColumn("turn", order).where(F.col("turn") <= probe).select("query_id", "segment"), "first")
    some = keep(top(scores(index, asked, first), "query_id", limit, F.desc("score"), F.asc("node_id")), "some")
    bar = some.where(F.col("rank") == limit).select("query_id", F.col("score").alias("bar"))
    rest = found.join(first, ["query_id", "segment"], "left_anti").join(bar, "query_id", "left").where("bar IS NULL OR bound >= bar")
    more = scores(index, asked, rest)
    return top(some.drop("rank").unionByName(more), "query_id", limit, F.desc("score"), F.asc("node_id"))


def skipped(index: StoredIndex, queries: DataFrame, limit: int = 20, probe: int = 4) -> DataFrame:
    """query_id, segments, read: how many segments hold a term of a question, and how many of them a search reads."""
    asked = keep(_asked(index, queries), "asked")
    found = keep(bounds(index, asked), "bounds")
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "segment"))
    ranked = found.withColumn("turn", turn)
    bar = top(scores(index, asked, ranked.where(F.col("turn") <= probe)), "query_id", limit, F.desc("score"), F.asc("node_id")).where(F.col("rank") == limit).select("query_id", F.col("score").alias("bar"))
    return ranked.join(bar, "query_id", "left").groupBy("query_id").agg(F.count("*").alias("segments"), F.count_if((F.col("turn") <= probe) | F.col("bar").isNull() | (F.col("bound") >= F.col("bar"))).alias("read"))
