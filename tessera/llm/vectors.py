"""Vectors in pages and blocks: what the two searches share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vectors: DataFrame, zero: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, vec (doubles) and the columns ``also`` of rows whose id is not null and whose components are all finite; with ``zero`` false, not all zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), *also)
    rows = rows.where("vec_id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND abs(x) < double('Infinity'))")
    return rows if zero else rows.where("exists(vec, x -> x <> 0)")


def one_per_id(rows: DataFrame) -> DataFrame:
    """For queries: of a repeated id, the smallest vector."""
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(vecs: pd.Series, dim: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors are filled with zeros."""
    out = np.zeros((len(vecs), dim))
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def matrix_of(data: bytes, dim: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dim)


def smallest_ids(ids: np.ndarray, most: int) -> np.ndarray:
    """Of the ids that share a vector those that any query can need: the ``most`` + 1 smallest, since a query's own falls out, each at most ``most`` times."""
    ids = np.sort(ids)
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    kind = np.cumsum(new) - 1
    again = np.arange(len(ids)) - np.flatnonzero(new)[kind]
    return ids[(kind <= most) & (again < most)]


def merge_copies(data: np.ndarray, ids: list[np.ndarray], most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct rows of ``data``, in a fixed order, and the ids each stands for."""
    kinds, kind = np.unique(data + 0.0, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    size = np.array([len(x) for x in ids])
    owner, flat = np.repeat(kind, size), np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
    order = np.lexsort((flat, owner))
    cuts = np.searchsorted(owner[order], np.arange(1, len(kinds)))
    return kinds, [smallest_ids(part, most) for part in np.split(flat[order], cuts)]


def distinct_vectors(rows: DataFrame, dim: int, most: int, cell: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """data (doubles), ids and cell: the distinct vectors of each batch with the ids that matter, so that copies are folded before any shuffle.

    A vector that is a third of all rows leaves one row per batch; ``merge_copies`` folds those where a page is built.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                data, ids = merge_copies(matrix(batch["vec"], dim), [np.array([i]) for i in batch["vec_id"].to_numpy(np.int64)], most)
                yield pd.DataFrame({"data": [x.tobytes() for x in data], "ids": ids, "cell": cell(data) if cell else 0})

    return rows.select("vec_id", "vec").mapInPandas(run, "data binary, ids array<long>, cell long")


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of a sorted stream, each as one frame."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for _, part in batch.groupby(key, sort=False):
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def pages(rows: DataFrame, dim: int, most: int, build: Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """One row per value of ``page`` with what ``build`` makes of its number, vectors, flat ids and where each vector's ids begin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in runs(batches, "page"):
            data, ids = merge_copies(np.frombuffer(b"".join(part["data"]), "<f8").reshape(len(part), dim), [np.asarray(x, np.int64) for x in part["ids"]], most)
            begin = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            number = int(part["page"].iloc[0])
            yield pd.DataFrame([{"page": number, **build(number, data, np.concatenate(ids), begin)}])

    return rows.select("page", "data", "ids").repartition("page").sortWithinPartitions("page").mapInPandas(run, f"page long, {schema}")


def blocks(asked: DataFrame, dim: int) -> DataFrame:
    """block, ids, data: the queries of each block as one row, by id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in runs(batches, "block"):
            part = part.sort_values("vec_id")
            yield pd.DataFrame([{"block": part["block"].iloc[0], "ids": part["vec_id"].to_numpy("<i8").tobytes(), "data": matrix(part["vec"], dim).tobytes()}])

    return asked.select("block", "vec_id", "vec").repartition("block").sortWithinPartitions("block").mapInPandas(run, "block long, ids binary, data binary")


def lots_of(n_pages: int) -> int:
    """How many groups of pages a block of queries meets, each in a task of its own."""
    return max(min(n_pages, 8), -(-n_pages // 65_536))


def in_cells(queries: DataFrame, pages: DataFrame, columns: list[str], lots: int) -> DataFrame:
    """Rows of a cell (block, lot) one after the other: first its queries (page null), then its pages by ``turn``.

    So that a block is sent to a task once, not beside every page. ``pages`` has block, page, turn and ``columns``.
    """
    empty = [F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in ["page", *columns]]
    first = queries.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).select((F.col("block") * lots + F.col("lot")).alias("cell"), F.lit(float("-inf")).alias("turn"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), *empty)
    rest = pages.select((F.col("block") * lots + F.pmod("page", F.lit(lots))).alias("cell"), F.col("turn").cast("double").alias("turn"), F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast("binary").alias("q_data"), "page", *columns)
    return first.unionByName(rest).repartition("cell").sortWithinPartitions("cell", "turn", "page")


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best, ties to the smaller vec_id."""
    w = W.partitionBy("query_id").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_of_each(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k lowest scores of each ``who``, ties to the smaller id, sorted; and the rank of each."""
    order = np.lexsort((ids, score, who))
    who, score, ids = who[order], score[order], ids[order]
    new = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
    rank = np.arange(len(who)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(who) else np.zeros(0, np.int64)
    kept = rank < k
    return who[kept], score[kept], ids[kept], rank[kept]


def expand(rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors ``rows``: the position in ``rows`` and in the flat ids of every id they stand for."""
    size = begin[rows + 1] - begin[rows]
    which = np.repeat(np.arange(len(rows)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[rows], size)
