"""The inverted index: postings, corpus statistics, BM25 and overlap ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scores import bm25_weight, idf
from tessera.functions.text import term_counts, tokenize
from tessera.session import keep, spread


#: Questions' terms that are sent to the workers as a list.
MOST_TERMS = 4096


def terms_of(docs: DataFrame, id_col: str = "id", text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """node_id, doc_len, terms and tfs: the one place where texts are tokenised, one row per document.

    With ``only``, terms but not the length are limited to those asked for.
    """
    rows = spread(docs.select(F.col(id_col).alias("node_id"), F.col(text_col).alias("text")))
    return rows.select("node_id", term_counts(F.col("text"), only).alias("t")).select("node_id", "t.*")


def postings(terms: DataFrame) -> DataFrame:
    """term, node_id, tf, doc_len: each document's own, so nothing is shuffled."""
    pairs = terms.select("node_id", "doc_len", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("p")).where("p IS NOT NULL")
    return pairs.select(F.col("p.terms").alias("term"), "node_id", F.col("p.tfs").alias("tf"), "doc_len")


def corpus_stats(terms: DataFrame) -> DataFrame:
    """doc_count and total_length, one row; documents without terms count."""
    return terms.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_length"))


def for_questions(docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings of the questions' terms and the corpus statistics, from one reading of the texts.

    The distinct terms of a small batch of questions go to the workers (with more than ``MOST_TERMS`` all terms are counted, to the same end); what comes
    back is a few numbers per document, kept as a table so that frequencies and scores don't read the texts again.
    """
    asked = [r.term for r in query_terms(queries).select("term").distinct().limit(MOST_TERMS + 1).collect()]
    terms = keep(terms_of(docs, id_col, text_col, asked if len(asked) <= MOST_TERMS else None), "terms")
    return postings(terms), corpus_stats(terms)


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id and each of its distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))


def bm25(post: DataFrame, stats: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, node_id, score, matched, rank: the best documents of each query, ties to the smaller id.

    A batch of queries is one program: postings are read once, how its terms meet them is the planner's choice, and each
    query's top is cut on every partition before ranks are given.
    """
    asked = query_terms(queries)
    hits = post.join(asked, "term")
    seen = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    weight = F.round(idf(F.col("doc_count"), F.col("df")) * bm25_weight(F.col("tf"), F.col("doc_len"), F.col("total_length") / F.col("doc_count")), 9)
    scored = hits.join(seen, ["query_id", "term"]).crossJoin(F.broadcast(stats)).groupBy("query_id", "node_id").agg(F.round(F.sum(weight), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))
    return top(scored, "query_id", limit, F.desc("score"), F.asc("node_id"))


def term_overlap(post: DataFrame, queries: DataFrame, limit: int = 60) -> DataFrame:
    """query_id, node_id, overlap, rank: documents by how many distinct terms they share with the query."""
    shared = post.join(query_terms(queries), "term").groupBy("query_id", "node_id").agg(F.count("*").alias("overlap"))
    return top(shared, "query_id", limit, F.desc("overlap"), F.asc("node_id"))


def top(df: DataFrame, by: str | list[str], limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows per group with their rank from 1."""
    keys = [by] if isinstance(by, str) else by
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def encode_postings(post: DataFrame) -> DataFrame:
    """The compact form: one row per term with id:tf:len entries, by id."""
    entry = F.struct("node_id", F.concat_ws(":", "node_id", F.col("tf").cast("string"), F.col("doc_len").cast("string")).alias("text"))
    return post.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), " ").alias("postings"), F.count("*").alias("df"))


def decode_postings(compact: DataFrame) -> DataFrame:
    """The long form again; an id may hold colons, so entries are read from the right."""
    entry = F.explode(F.split("postings", " ")).alias("entry")
    pattern = r"^(.*):([0-9]+):([0-9]+)$"
    part = lambda i: F.regexp_extract("entry", pattern, i)
    return compact.select("term", entry).select("term", part(1).alias("node_id"), part(2).cast("int").alias("tf"), part(3).cast("int").alias("doc_len"))


def remove_documents(post: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without the documents of ``gone``; frequencies and lengths follow, since they are derived."""
    return post.join(gone.select("node_id").distinct(), "node_id", "left_anti").select("term", "node_id", "tf", "doc_len")
