"""Exact top-k inner products by best-first search of a paged M-tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import best, blocks, distinct_vectors, expand, first_of_each, in_cells, lots_of, matrix, matrix_of, one_per_id, pages, usable
from tessera.session import discard, keep

NODE = ["root", "ids", "begin", "data", "kind", "node_at", "routers", "radii", "to_page", "to_node", "radius"]
SCHEMA = "root long, ids binary, begin binary, data binary, kind string, node_at binary, routers binary, radii binary, to_page binary, to_node binary, radius double"
FLUSH = 1 << 20


class Space:
    """The metric the tree is built in.

    With ``top`` at least the largest norm, a vector x gets one more component sqrt(top^2 - |x|^2) and a
    query q a zero there: then |q - x|^2 = |q|^2 + top^2 - 2 q.x, so the nearest are those of the highest
    inner product and the triangle inequality bounds it.
    """

    def __init__(self, top: float):
        self.top = top

    def point(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.top - (x * x).sum(axis=1)))])

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))])

    def score(self, norm: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """No inner product is above this at a distance of at least ``distance``."""
        bound = (norm + self.top - distance * distance) / 2
        return bound + 1e-9 * (np.abs(norm) + self.top + 1)

    def reach(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """No vector farther than this has an inner product of ``score``."""
        return np.sqrt(np.maximum(0.0, norm + self.top - 2 * score)) + 1e-7 * (1 + np.sqrt(np.abs(norm) + self.top))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T))


def smallest_type(data: np.ndarray) -> str:
    """The narrowest type that holds integers as they are."""
    most = float(np.abs(data).max()) if data.size else 0.0
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"


def build_page(data: np.ndarray, ids: np.ndarray, begin: np.ndarray, root: int, pivot: np.ndarray, space: Space, leaf: int = 64) -> dict:
    """A page: leaf nodes around routers picked farthest first, each with a covering radius and its distance
    to the page's router; entries lie by node and by distance to its router."""
    points = space.point(data)
    to_pivot = distances(points, pivot[None])[:, 0]
    routers, gap = [int(to_pivot.argmin())], distances(points, points[[int(to_pivot.argmin())]])[:, 0]
    while len(routers) < -(-len(data) // leaf) and gap.max() > 0:
        routers.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[routers[-1:]])[:, 0])
    apart = distances(points, points[routers])
    node = apart.argmin(axis=1)
    own = apart[np.arange(len(data)), node]
    order = np.lexsort((own, node))
    radii = np.zeros(len(routers))
    np.maximum.at(radii, node, own)
    kind, (which, at) = smallest_type(data), expand(order, begin)
    return {
        "root": root,
        "ids": ids[at].astype("<i8").tobytes(),
        "begin": np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(order)))]).astype("<i8").tobytes(),
        "data": data[order].astype(kind).tobytes(),
        "kind": kind,
        "node_at": np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(routers)))]).astype("<i8").tobytes(),
        "routers": data[routers].astype(kind).tobytes(),
        "radii": radii.tobytes(),
        "to_page": to_pivot[routers].tobytes(),
        "to_node": own[order].tobytes(),
        "radius": float(to_pivot.max()),
    }


def products(q: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Inner products of integer vectors of squared norms up to ``top``: in the narrowest floats that hold them all, else in integers."""
    if top < 2**24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if top < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Search:
    """The search of one block of queries: the root's pivots, then pages and their nodes, with the best k so far."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, floor: np.ndarray, k: int, space: Space, pivots: np.ndarray):
        self.ids, self.data, self.k, self.space = ids, data, k, space
        self.points, self.norm = space.query(data), (data * data).sum(axis=1)
        self.to_pivots = distances(self.points, pivots)
        self.floor = floor.astype(np.float64)
        self.bar, self.last = self.floor.copy(), np.full(len(ids), np.iinfo(np.int64).max)
        self.who, self.score, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = self.computed = 0

    def bounds(self, root: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For pages: by how much the best of any query's possible scores passes its bar; below 0 none can."""
        out = np.full(len(root), -np.inf)
        for c in np.unique(root):
            at = np.flatnonzero(root == c)
            near = np.maximum(0.0, self.to_pivots[:, c : c + 1] - radius[at])
            out[at] = (self.space.score(self.norm[:, None], near) - self.bar[:, None]).max(axis=0)
        return out

    def page(self, row) -> None:
        space, to_pivot = self.space, self.to_pivots[:, int(row.root)]
        alive = np.flatnonzero(space.score(self.norm, np.maximum(0.0, to_pivot - row.radius)) >= self.bar)
        if not len(alive):
            return
        dim = self.data.shape[1]
        data, routers = matrix_of(row.data, dim, row.kind), space.point(matrix_of(row.routers, dim, row.kind).astype(np.float64))
        ids, begin, at, to_node = (np.frombuffer(x, t) for x, t in ((row.ids, "<i8"), (row.begin, "<i8"), (row.node_at, "<i8"), (row.to_node, "<f8")))
        radii, to_page = np.frombuffer(row.radii, "<f8"), np.frombuffer(row.to_page, "<f8")
        # what the stored distances to the page's router already exclude needs no distance to the node's router
        near = np.maximum(0.0, np.abs(to_pivot[alive, None] - to_page) - radii)
        able = space.score(self.norm[alive, None], near) >= self.bar[alive, None]
        apart = np.full(able.shape, np.inf)
        for c in np.flatnonzero(able.any(axis=0)):
            own = able[:, c]
            apart[own, c] = distances(self.points[alive[own]], routers[c : c + 1])[:, 0]
        low = np.where(able, np.maximum(0.0, apart - radii), np.inf)
        nearest = low.min(axis=0)
        for c in np.argsort(nearest, kind="stable"):
            if not np.isfinite(nearest[c]):
                break
            bound = low[:, c]
            go = np.isfinite(bound)
            go[go] = space.score(self.norm[alive[go]], bound[go]) >= self.bar[alive[go]]
            if go.any():
                self._leaf(alive[go], apart[go, c], at[c], at[c + 1], to_node, data, ids, begin)
        self._settle()

    def _leaf(self, who: np.ndarray, d: np.ndarray, start: int, end: int, to_node: np.ndarray, data: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> None:
        bar = self.bar[who]
        reach = np.where(np.isfinite(bar), self.space.reach(self.norm[who], np.where(np.isfinite(bar), bar, 0.0)), np.inf)
        own = to_node[start:end]
        a, b = start + np.searchsorted(own, (d - reach).min()), start + np.searchsorted(own, (d + reach).max(), side="right")
        if a >= b:
            return
        self.computed += len(who) * int(b - a)
        s = products(self.data[who], data[a:b], self.space.top)
        i, j = np.nonzero(s >= bar[:, None])
        if not len(i):
            return
        which, at = expand(a + j, begin)
        query, score, vec = who[i[which]], s[i, j][which], ids[at]
        use = (vec != self.ids[query]) & ((score > self.bar[query]) | (vec < self.last[query]))
        self.new.append((query[use], score[use], vec[use]))
        self.waiting += int(use.sum())
        if self.waiting > FLUSH:
            self._settle()

    def _settle(self) -> None:
        """Keep each query's best k of old and new, and raise its bar to the last of them."""
        if not self.waiting:
            self.new = []
            return
        who, score, found = (np.concatenate([old, *new]) for old, new in zip((self.who, self.score, self.found), zip(*self.new)))
        self.who, less, self.found, rank = first_of_each(who, -score, found, self.k)
        self.score, self.new, self.waiting = -less, [], 0
        full = rank == self.k - 1
        q = self.who[full]
        raised = self.score[full] >= self.bar[q]
        self.bar[q[raised]], self.last[q[raised]] = self.score[full][raised], self.found[full][raised]

    def result(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.who], "vec_id": self.found, "score": self.score})


def _deal(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """cell, first, parts: large cells get several numbers of their own, small neighbours share one, about ``most`` rows each."""
    out, number, held = [], 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if n > most:
            if held:
                number, held = number + 1, 0
            parts = -(-n // most)
            out.append((cell, number, parts))
            number += parts
        else:
            if held + n > most:
                number, held = number + 1, 0
            out.append((cell, number, 1))
            held += n
    return out


def top_products(vectors: DataFrame, is_query: Column, *, k: int = 20, scale: int = 64, page_rows: int = 2048, block_rows: int = 8192, sample_rows: int = 8192) -> DataFrame:
    """Each query's k highest integer inner products with every row but those of its own id.

    Components x become floor(scale * x). Copies of a vector are one entry with the ids that can matter. Entries go to the nearest of at
    most 256 pivots, the root of the tree; a pivot's entries lie in pages (a populous pivot's by hash in several), each a small M-tree
    stored as one row (see ``build_page``). Queries near the same pivots form blocks. A query starts from the k-th best product with
    ``sample_rows`` rows picked by hash: a lower bound that prunes, never the answer. First only the pages' radii meet the blocks;
    pages that can hold an answer then travel, and are searched most promising first, and in each the nodes nearest first.

    Rows with a null id, a null vector or a null or non-finite component take no part; of a repeated query id the smallest
    vector asks, while every row is a candidate; shorter vectors count as filled with zeros; products are
    to fit a long. An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    # a query is told by its id, so that extra columns can't clash
    rows = keep(usable(vectors).select("vec_id", F.transform("vec", lambda x: F.floor(x * float(scale)).cast("double")).alias("vec")), "whole")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    asked = one_per_id(rows.where(is_query))
    n_asked = asked.count()
    if not facts.n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, space, top = max(1, facts.dim), Space(float(facts.top)), float(facts.top)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample_rows).toPandas()
    sample_ids, sample_data = sample["vec_id"].to_numpy(np.int64), matrix(sample["vec"], dim)
    pivots = space.point(np.unique(sample_data[: min(256, -(-facts.n // page_rows))], axis=0))
    sample_data = sample_data.astype(smallest_type(sample_data))

    def cell_of(data: np.ndarray) -> np.ndarray:
        return distances(space.point(data), pivots).argmin(axis=1)

    def dealt(df: DataFrame, parts: list, name: str, by: str) -> DataFrame:
        layout = spark.createDataFrame(parts, "cell long, first long, parts long")
        return df.join(F.broadcast(layout), "cell").withColumn(name, F.col("first") + F.pmod(F.xxhash64(by, F.lit(7)), F.col("parts")))

    entries = keep(distinct_vectors(rows, dim, k, cell_of), "entries")
    sizes = {r.cell: r["count"] for r in entries.groupBy("cell").count().collect()}
    parts, at = [], 0
    for cell in sorted(sizes):
        parts.append((cell, at, -(-sizes[cell] // page_rows)))
        at += parts[-1][2]
    n_pages, own = at, np.repeat([c for c, _, _ in parts], [p for _, _, p in parts])
    tree = keep(pages(dealt(entries, parts, "page", "data"), dim, k, lambda number, data, ids, begin: build_page(data, ids, begin, int(own[number]), pivots[own[number]], space), SCHEMA), "pages")
    discard(entries)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = space.query(matrix(batch["vec"], dim))
            yield batch.assign(cell=distances(points, pivots).argmin(axis=1) if len(batch) else [])

    questions = keep(asked.mapInPandas(place, "vec_id long, vec array<double>, cell long"), "questions")
    crowd = {r.cell: r["count"] for r in questions.groupBy("cell").count().collect()}
    queries = keep(blocks(dealt(questions, _deal(crowd, block_rows), "block", "vec_id"), dim), "queries")
    discard(rows, questions)

    def started(q_ids: bytes, q_data: bytes) -> Search:
        ids, data = np.frombuffer(q_ids, "<i8"), matrix_of(q_data, dim)
        s = products(data, sample_data, top).astype(np.float64)
        s[ids[:, None] == sample_ids[None]] = -np.inf
        floor = np.full(len(ids), -np.inf) if s.shape[1] < k else np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return Search(ids, data, floor, k, space, pivots)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                bound = started(row.ids, row.data).bounds(np.asarray(row.roots, np.int64), np.asarray(row.radii, np.float64))
                use = bound >= 0
                yield pd.DataFrame({"block": row.block, "page": np.asarray(row.pages, np.int64)[use], "turn": -bound[use]})

    lots = lots_of(n_pages)
    shapes = tree.select("page", "root", "radius").groupBy(F.pmod("page", F.lit(lots)).alias("lot")).agg(F.collect_list("page").alias("pages"), F.collect_list("root").alias("roots"), F.collect_list("radius").alias("radii"))
    beside = queries.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).withColumn("lot", F.col("lot").cast("long")).join(shapes, "lot")
    pairs = beside.mapInPandas(meet, "block long, page long, turn double")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            for row in batch.itertuples():
                if row.q_ids is not None:
                    if state is not None:
                        yield state.result()
                    state = started(row.q_ids, row.q_data)
                else:
                    state.page(row)
        if state is not None:
            yield state.result()

    found = in_cells(queries, pairs.join(tree, "page"), NODE, lots).mapInPandas(search, "query_id long, vec_id long, score long")
    return best(found, k, F.desc("score"))
