"""Hard negatives: a distributed nearest-neighbour join over Voronoi cells, ranged by the scores of the positives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.mtree import Space, _deal, distances, products, smallest_type
from tessera.llm.vectors import first_of_each, in_cells, lots_of, matrix, matrix_of, runs, usable
from tessera.session import discard, keep

#: A question: whose it is, the label, whether rows of that label (or of others) answer, the highest and lowest score it takes.
TARGET = np.dtype([("anchor", "<i8"), ("positive", "<i8"), ("of", "<i8"), ("label", "<i8"), ("same", "?"), ("cap", "<f8"), ("floor", "<f8")])
PAGE = ["root", "low", "high", "ids", "labels", "away", "data", "kind"]
PAGES = "page long, root long, low double, high double, ids binary, labels binary, away binary, data binary, kind string"
FOUND = "anchor long, positive long, vec_id long, score long"
FLUSH = 1 << 20


class Join:
    """The questions of one block against candidates: bounds from pivots, then exact products; the best k of each question so far."""

    def __init__(self, targets: bytes, data: bytes, dim: int, k: int, space: Space, pivots: np.ndarray, sample: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.t, self.data, self.k, self.space = np.frombuffer(targets, TARGET), matrix_of(data, dim), k, space
        self.norm = (self.data * self.data).sum(axis=1)
        self.to_pivots = distances(space.query(self.data), pivots)
        self.bar, self.last = self.t["floor"].copy(), np.full(len(self.t), np.iinfo(np.int64).max)
        self.who, self.score, self.found = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.floor_by(*sample)

    def floor_by(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """The k-th best of a few rows: the answer can't be below it, so what is below need not come. Only the bound is kept."""
        for at in range(0, len(self.t), 512):
            part = slice(at, at + 512)
            s = self._fitting(np.arange(len(self.t))[part], products(self.data[self.t["of"][part]], vectors, self.space.top), ids, labels)
            if s.shape[1] >= self.k:
                self.bar[part] = np.maximum(self.bar[part], np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])

    def _fitting(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        t = self.t[who]
        fits = ((labels[None] == t["label"][:, None]) == t["same"][:, None]) & (ids[None] != t["anchor"][:, None]) & (scores <= t["cap"][:, None]) & (scores >= self.bar[who, None])
        return np.where(fits, scores, -np.inf)

    def able(self, cell: int, low: float, high: float) -> np.ndarray:
        """By how much the best possible score of candidates between ``low`` and ``high`` from the pivot passes each question's bar; -inf if their worst is above its cap."""
        own = self.to_pivots[self.t["of"], cell]
        near, far = np.maximum(0.0, np.maximum(own - high, low - own)), own + high
        norm = self.norm[self.t["of"]]
        slack = 1e-9 * (np.abs(norm) + self.space.top + 1)
        worst = (norm + self.space.top - far * far) / 2 - slack
        return np.where(worst <= self.t["cap"], self.space.score(norm, near) - self.bar, -np.inf)

    def page(self, row) -> None:
        alive = np.flatnonzero(self.able(int(row.root), row.low, row.high) >= 0)
        if not len(alive):
            return
        ids, labels, away = (np.frombuffer(x, t) for x, t in ((row.ids, "<i8"), (row.labels, "<i8"), (row.away, "<f8")))
        data = matrix_of(row.data, self.data.shape[1], row.kind)
        for part in np.array_split(alive, -(-len(alive) // 1024)):
            of = self.t["of"][part]
            own, norm, bar = self.to_pivots[of, int(row.root)], self.norm[of], self.bar[part]
            reach = np.where(np.isfinite(bar), self.space.reach(norm, np.where(np.isfinite(bar), bar, 0.0)), np.inf)
            a, b = np.searchsorted(away, (own - reach).min()), np.searchsorted(away, (own + reach).max(), side="right")
            if a >= b:
                continue
            anchors, which = np.unique(of, return_inverse=True)
            scores = products(self.data[anchors], data[a:b], self.space.top)[which.reshape(-1)]
            i, j = np.nonzero(np.isfinite(self._fitting(part, scores, ids[a:b], labels[a:b])))
            if len(i):
                use = (scores[i, j] > bar[i]) | (ids[a:b][j] < self.last[part[i]])
                self.new.append((part[i[use]], scores[i, j][use], ids[a:b][j[use]]))
                self.waiting += int(use.sum())
                if self.waiting > FLUSH:
                    self.settle()
        self.settle()

    def settle(self) -> None:
        if not self.waiting:
            self.new = []
            return
        who, score, found = (np.concatenate([old, *new]) for old, new in zip((self.who, self.score, self.found), zip(*self.new)))
        self.who, less, self.found, rank = first_of_each(who, -score, found, self.k)
        self.score, self.new, self.waiting = -less, [], 0
        full = rank == self.k - 1
        at = self.who[full]
        raised = self.score[full] >= self.bar[at]
        self.bar[at[raised]], self.last[at[raised]] = self.score[full][raised], self.found[full][raised]

    def result(self) -> pd.DataFrame:
        return pd.DataFrame({"anchor": self.t["anchor"][self.who], "positive": self.t["positive"][self.who], "vec_id": self.found, "score": self.score})


def build_pages(rows: DataFrame, dim: int) -> DataFrame:
    """One row per page: its candidates by distance to the pivot, and the least and greatest of these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in runs(batches, "page"):
            part = part.sort_values(["away", "vec_id"])
            data = matrix(part["vec"], dim)
            kind, away = smallest_type(data), part["away"].to_numpy(np.float64)
            yield pd.DataFrame([{"page": int(part["page"].iloc[0]), "root": int(part["cell"].iloc[0]), "low": away[0], "high": away[-1], "ids": part["vec_id"].to_numpy("<i8").tobytes(), "labels": part["label"].to_numpy("<i8").tobytes(), "away": away.tobytes(), "data": data.astype(kind).tobytes(), "kind": kind}])

    return rows.select("page", "cell", "away", "vec_id", "label", "vec").repartition("page").sortWithinPartitions("page").mapInPandas(run, PAGES)


def blocks_of(questions: DataFrame, dim: int) -> DataFrame:
    """block, ids, data: the questions of a block as one row; an anchor's vector is there once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in runs(batches, "block"):
            anchors = part.drop_duplicates("vec_id").sort_values("vec_id")
            of = np.searchsorted(anchors["vec_id"].to_numpy(np.int64), part["vec_id"].to_numpy(np.int64))
            t = np.zeros(len(part), TARGET)
            t["anchor"], t["positive"], t["of"], t["label"], t["same"], t["cap"], t["floor"] = part["vec_id"], part["positive"], of, part["label"], part["same"], part["cap"], part["floor"]
            yield pd.DataFrame([{"block": part["block"].iloc[0], "ids": t.tobytes(), "data": matrix(anchors["vec"], dim).tobytes()}])

    return questions.select("block", "vec_id", "vec", "label", "positive", "same", "cap", "floor").repartition("block").sortWithinPartitions("block").mapInPandas(run, "block long, ids binary, data binary")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, label: Column | None = None, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256, page_rows: int = 2048, block_rows: int = 2048, sample_rows: int = 8192
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score
    lies between ``low_percent`` and ``high_percent`` of the positive's.

    Components x become floor(scale * x), scores are integer inner products, ties go to the smaller vec_id. A vector gets one more component that makes all
    norms equal, so that the nearest are those of the highest score. Rows go to the nearest of at most 256 pivots and, in a
    cell, to pages by ranges of distance to the pivot (a range of more than ``page_rows`` rows by hash in several: copies of one vector
    are spread). Anchors near the same pivot form groups. An anchor's k-th best score among ``sample_rows`` rows picked by
    hash bounds the answer from below; with it the triangle inequality tells which pages any anchor of a group can need, and for negatives also which
    are too near. Only these are copied to the group and joined there exactly. The join runs twice: for the positives, then for a range of scores
    per positive.

    A row with a null id, label or vector, or a null or non-finite component, takes no part; of a repeated id the row of the smallest label,
    then vector, counts; anchors without a positive, positives of a negative score and those without a fitting negative give no rows;
    shorter vectors count as filled with zeros; products are to fit a long, and scores 2^53; an empty table gives no rows. ``label`` replaces
    the column of that name; extra columns are ignored.
    """
    spark = vectors.sparkSession
    told = vectors.withColumn("label", (label if label is not None else F.col("label")).cast("long")).where("label IS NOT NULL").select("vec_id", "embedding", "label")
    rows = usable(told, also=("label",)).select("vec_id", "label", F.transform("vec", lambda x: F.floor(x * float(scale)).cast("double")).alias("vec"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")
    rows = keep(rows, "rows")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not facts.n:
        return empty
    dim, space = max(1, facts.dim), Space(float(facts.top))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    sampled = matrix(sample["vec"], dim)
    pivots = space.point(np.unique(sampled[: min(256, -(-facts.n // page_rows))], axis=0))
    few = (sample["vec_id"].to_numpy(np.int64), sample["label"].to_numpy(np.int64), sampled.astype(smallest_type(sampled)))

    def nearest(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = distances(points, pivots)
        cell = apart.argmin(axis=1)
        return cell, apart[np.arange(len(cell)), cell]

    # ranges of distance: 16ths of the sample's rows in a cell
    cell, away = nearest(space.point(sampled))
    edges = [np.quantile(away[cell == c], np.arange(1, 16) / 16) if (cell == c).any() else np.zeros(15) for c in range(len(pivots))]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, away = nearest(space.point(matrix(batch["vec"], dim)))
                yield batch.assign(cell=cell, away=away, ring=[c * 16 + int(np.searchsorted(edges[c], a)) for c, a in zip(cell, away)])

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=nearest(space.query(matrix(batch["vec"], dim)))[0])

    def dealt(df: DataFrame, key: str, name: str, most: int) -> DataFrame:
        sizes = {r[key]: r["count"] for r in df.groupBy(key).count().collect()}  # at most 4,096 rings of 256 cells
        layout = [(c, at, parts) for c, at, parts in (_deal(sizes, most) if name == "block" else _rings(sizes, most))]
        return df.join(F.broadcast(spark.createDataFrame(layout, f"{key} long, first long, parts long")), key).withColumn(name, F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")))

    candidates = keep(rows.mapInPandas(placed, "vec_id long, label long, vec array<double>, cell long, away double, ring long"), "placed")
    paged = keep(build_pages(dealt(candidates, "ring", "page", page_rows), dim), "pages")
    discard(candidates)
    shape = paged.select("page", "root", "low", "high")
    n_pages = shape.count()
    lots = lots_of(n_pages)

    def joined(questions: DataFrame, k: int, name: str) -> DataFrame:
        """anchor, positive, vec_id, score, rank: each question's first k."""
        asked = keep(blocks_of(questions, dim), f"blocks-{name}")

        def started(targets: bytes, data: bytes) -> Join:
            return Join(targets, data, dim, k, space, pivots, few)

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    join = started(row.ids, row.data)
                    turn = np.array([join.able(int(c), a, b).max() for c, a, b in zip(row.cells, row.lows, row.highs)])
                    use = turn >= 0
                    yield pd.DataFrame({"block": row.block, "page": np.asarray(row.pages, np.int64)[use], "turn": -turn[use]})

        shapes = shape.groupBy(F.pmod("page", F.lit(lots)).alias("lot")).agg(F.collect_list(F.struct("page", "root", "low", "high")).alias("all")).select("lot", F.col("all.page").alias("pages"), F.col("all.root").alias("cells"), F.col("all.low").alias("lows"), F.col("all.high").alias("highs"))
        beside = asked.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).withColumn("lot", F.col("lot").cast("long")).join(shapes, "lot")
        met = beside.mapInPandas(meet, "block long, page long, turn double")

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            join = None
            for batch in batches:
                for row in batch.itertuples():
                    if row.q_ids is not None:
                        if join is not None:
                            yield join.result()
                        join = started(row.q_ids, row.q_data)
                    else:
                        join.page(row)
            if join is not None:
                yield join.result()

        found = in_cells(asked, met.join(paged, "page"), PAGE, lots).mapInPandas(search, FOUND)
        first = W.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)

    anchors = rows.where(is_anchor).mapInPandas(asking, "vec_id long, label long, vec array<double>, cell long")
    anchors = keep(dealt(keep(anchors, "anchors"), "cell", "block", block_rows).select("block", "vec_id", "label", "vec"), "dealt")
    any_score = [F.lit(float("inf")).alias("cap"), F.lit(float("-inf")).alias("floor")]
    chosen = keep(joined(anchors.select("*", F.lit(-1).cast("long").alias("positive"), F.lit(True).alias("same"), *any_score), positives, "positives").select("anchor", F.col("vec_id").alias("positive"), F.col("score").alias("p_score")), "positives")
    bounds = [F.expr(f"cast({high_percent} * p_score as double) / 100").alias("cap"), F.expr(f"cast({low_percent} * p_score as double) / 100").alias("floor")]
    ranged = chosen.where(f"{low_percent} * p_score <= {high_percent} * p_score").select(F.col("anchor").alias("vec_id"), "positive", *bounds)
    questions = anchors.join(ranged, "vec_id").withColumn("same", F.lit(False))
    out = joined(questions, negatives, "negatives").join(chosen, ["anchor", "positive"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))


def _rings(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """ring, first page, pages: neighbouring rings of a cell share a page while they fit, a populous one has several."""
    out, number, held, cell = [], -1, 0, None
    for ring in sorted(sizes):
        n = sizes[ring]
        if n > most or ring // 16 != cell or held + n > most:
            number, held, cell = number + 1, 0, ring // 16
        parts = -(-n // most)
        out.append((ring, number, parts))
        held += n
        if parts > 1:
            number, cell = number + parts - 1, None
    return out


#: The same for DuckDB, each anchor against each row.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor, other, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
), fitting AS (
  SELECT p.anchor, p.other AS positive, p.score AS positive_score, n.other AS negative, n.score, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, rank, negative AS negative_id, positive_score, score AS negative_score FROM fitting WHERE rank <= 10
"""
