"""Approximate nearest neighbours by additive quantisation with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import best, blocks, distinct_vectors, expand, first_of_each, in_cells, lots_of, matrix, matrix_of, one_per_id, pages, usable
from tessera.session import keep

SCHEMA = "ids binary, begin binary, data binary, codes binary, norms binary, errors binary"
#: A code's place: page * PLACES + number of the code in its page.
PLACES = 1 << 20
#: Pages that a task holds while blocks of queries pass.
LOT_PAGES = 64


@dataclass
class Codebooks:
    """``books`` x ``words`` code words, each of the full dimension; a vector is the sum of one word per book."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes by beam search: after each book the ``beam`` partial sums of least error are kept."""
        x = x.astype(np.float32)
        n, books = len(x), len(self.words)
        rest, error, codes = x[:, None, :], (x * x).sum(axis=1)[:, None], np.zeros((n, 1, books), np.uint8)
        row = np.arange(n)[:, None]
        for m, w in enumerate(self.words):
            width, k = rest.shape[1], len(w)
            flat = ((error[:, :, None] + (w * w).sum(axis=1)) - 2 * (rest.reshape(n * width, -1) @ w.T).reshape(n, width, k)).reshape(n, -1)
            most = min(beam, flat.shape[1]) if m < books - 1 else 1
            pick = np.argpartition(flat, most - 1, axis=1)[:, :most] if most < flat.shape[1] else np.tile(np.arange(most), (n, 1))
            parent, word = np.divmod(pick, k)
            error, rest, codes = np.take_along_axis(flat, pick, 1), rest[row, parent] - w[word], codes[row, parent]
            codes[:, :, m] = word
        return codes[:, 0, :]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(w[codes[:, m]] for m, w in enumerate(self.words))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Lookup tables of queries: books x words x queries, -2 q.word."""
        return np.stack([-2 * (w @ q.astype(np.float32).T) for w in self.words])

    def scores(self, tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """codes x queries: |decoded|^2 - 2 q.decoded, by lookups and the stored norms only."""
        out = np.repeat(norms.astype(np.float32)[:, None], tables.shape[2], axis=1)
        for m in range(len(tables)):
            out += tables[m][codes[:, m]]
        return out


def train(x: np.ndarray, *, books: int = 64, words: int = 16, rounds: int = 3, beam: int = 2, seed: int = 5) -> Codebooks:
    """Residual k-means, then rounds of encoding and a least-squares fit of all books at once."""
    x = x.astype(np.float32)
    rng, rest, out = np.random.default_rng(seed), x.copy(), np.zeros((books, words, x.shape[1]), np.float32)
    nearest = lambda c: ((c * c).sum(axis=1) - 2 * rest @ c.T).argmin(axis=1)
    one = np.eye(words, dtype=np.float32)
    for m in range(books):
        centre = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(6):
            hot = one[nearest(centre)]
            count = hot.sum(axis=0)
            centre[count > 0] = (hot.T @ rest)[count > 0] / count[count > 0, None]
        out[m] = centre
        rest = rest - centre[nearest(centre)]
    model = Codebooks(out)
    for _ in range(rounds):
        hot = one[model.encode(x, beam)].reshape(len(x), -1)
        still = 0.1 * np.eye(books * words)
        fit = np.linalg.solve(hot.T @ hot + still, hot.T @ x + 0.1 * model.words.reshape(books * words, -1))
        model = Codebooks(fit.astype(np.float32).reshape(out.shape))
    return model


class Nearest:
    """The k nearest of each query of a block over the pages of a lot, by bounds first.

    A code says where its vector is, and ``errors`` how far off at most, so a vector whose code lies further than the radius plus its error can't be among the
    nearest. The rest are compared exactly. ``radius`` is a distance within which k rows are known to lie.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, centred: np.ndarray, radius: np.ndarray, scale: float, k: int):
        self.ids, self.q, self.centred, self.scale, self.k = ids, q, centred, scale, k
        self.radius, self.square = radius, (centred * centred).sum(axis=1)
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def page(self, decoded: np.ndarray, errors: np.ndarray, data: np.ndarray, ids: np.ndarray, begin: np.ndarray, step: int = 256) -> None:
        norms = (decoded * decoded).sum(axis=1)
        for first in range(0, len(self.q), step):
            part = slice(first, first + step)
            both = norms + self.square[part, None]
            # what rounding can add to a squared distance is a small part of the two squares
            least = np.sqrt(np.maximum(both - 2 * (self.centred[part] @ decoded.T) - 1e-12 * both, 0)) - errors
            who, entry = np.nonzero(~(least > self.radius[part, None] / self.scale * (1 + 1e-9)))
            if not len(who):
                continue
            who += first
            near = np.concatenate([np.sqrt(((data[entry[i : i + 65_536]] - self.q[who[i : i + 65_536]]) ** 2).sum(axis=1)) for i in range(0, len(who), 65_536)])
            close = ~(near > self.radius[who])
            who, entry, near = who[close], entry[close], near[close]
            pair, flat = expand(entry, begin)
            other = ids[flat] != self.ids[who[pair]]
            old = [a for a in self.found]
            mine = (old[0] >= first) & (old[0] < first + step)
            who, near, found, rank = first_of_each(*(np.concatenate([a[mine], b]) for a, b in zip(old, (who[pair][other], near[pair][other], ids[flat][other]))), self.k)
            full = rank == self.k - 1
            self.radius[who[full]] = np.minimum(self.radius[who[full]], near[full])
            self.found = tuple(np.concatenate([a[~mine], b]) for a, b in zip(old, (who, near, found)))


class Shortlist:
    """The best codes of each query of a block, over the pages seen."""

    def __init__(self, model: Codebooks, q: np.ndarray, most: int):
        self.model, self.tables, self.most = model, model.tables(q), most
        self.score, self.place = np.full((len(q), 0), np.inf, np.float32), np.zeros((len(q), 0), np.int64)

    def add(self, score: np.ndarray, place: np.ndarray) -> None:
        score, place = np.concatenate([self.score, score], axis=1), np.concatenate([self.place, np.broadcast_to(place, score.shape[:1] + place.shape[-1:])], axis=1)
        if score.shape[1] > self.most:
            pick = np.argpartition(score, self.most - 1, axis=1)[:, : self.most]
            score, place = np.take_along_axis(score, pick, 1), np.take_along_axis(place, pick, 1)
        self.score, self.place = score, place

    def page(self, number: int, codes: np.ndarray, norms: np.ndarray) -> None:
        kinds, first = np.unique(codes, axis=0, return_index=True)
        self.add(self.model.scores(self.tables, kinds, norms[first]).T, number * PLACES + np.arange(len(kinds)))


def nearest_neighbours(vectors: DataFrame, is_query: Column, *, k: int = 10, page_rows: int = 2048, block_rows: int = 4096, sample_rows: int = 8192, rerank: int = 128) -> DataFrame:
    """Each query's k nearest found by Euclidean distance, of every row but those of its own id.

    The codebooks are fitted on ``sample_rows`` rows picked by hash, shifted to their middle and scaled; every row is encoded, and how far its
    code is off is stored with it. Copies of a vector are one entry with the ids that can matter, so no copy is lost to another and none
    pushes other rows out. Entries lie in pages by hash, a page being one row. Four steps, each moving what it needs: blocks of queries meet the
    pages' codes and norms, score them by lookups and keep the best ``rerank`` distinct codes of every lot of pages; a query's lists are
    merged to its best ``rerank`` of all pages; the pages named there, with the queries that name them, are joined to the original vectors, and all entries
    of these codes ranked exactly. The k-th of them is a radius, and all entries whose codes and errors don't put them outside of it are
    compared, lot by lot, so nothing nearer is missed, however coarse the codes are for these rows.

    Rows with a null id, a null or zero vector or a null or non-finite component take no part; of a repeated query id
    the smallest vector asks; shorter vectors count as filled with zeros. An empty table, or one without
    queries, gives no rows.
    """
    spark = vectors.sparkSession
    rows = keep(usable(vectors, zero=False), "whole")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.count(F.when(is_query, 1)).alias("asked")).first()
    if not facts.n or not facts.asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n_pages, n_blocks, most = facts.dim, -(-facts.n // page_rows), -(-facts.asked // block_rows), max(rerank, 2 * k)
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample_rows).toPandas()["vec"], dim)
    middle = np.median(sample, axis=0)
    scale = float(np.median(np.abs(sample - middle).max(axis=1))) or float(np.abs(sample - middle).max()) or 1.0
    # codes are made in single precision: far-off rows are moved in for them, and their errors say so
    centred = lambda x: (x - middle) / scale
    near = lambda x: np.clip(centred(x), -1e3, 1e3)
    model = train(near(sample))
    books, exact_words = len(model.words), Codebooks(model.words.astype(np.float64))

    def page(number: int, data: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> dict:
        codes = model.encode(near(data))
        decoded = exact_words.decode(codes)
        errors = np.sqrt(((centred(data) - decoded) ** 2).sum(axis=1)) * (1 + 1e-9)
        return {"errors": errors.astype("<f8").tobytes(), "ids": ids.tobytes(), "begin": begin.astype("<i8").tobytes(), "data": data.tobytes(), "codes": codes.tobytes(), "norms": (decoded * decoded).sum(axis=1).astype("<f4").tobytes()}

    entries = distinct_vectors(rows, dim, k).withColumn("page", F.pmod(F.xxhash64("data", F.lit(7)), F.lit(n_pages)))
    index = keep(pages(entries, dim, k, page, SCHEMA), "pages")
    asked = one_per_id(rows.where(is_query)).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(n_blocks)))
    queries = keep(blocks(asked, dim), "queries")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ids, state = 0, b"", None

        def told() -> pd.DataFrame:
            return pd.DataFrame([{"cell": cell, "width": state.score.shape[1], "scores": state.score.tobytes(), "places": state.place.tobytes()}])

        for batch in batches:
            for row in batch.itertuples():
                if row.q_ids is not None:
                    if state is not None:
                        yield told()
                    cell, state = row.cell, Shortlist(model, near(matrix_of(row.q_data, dim)), most)
                else:
                    state.page(int(row.page), np.frombuffer(row.codes, np.uint8).reshape(-1, books), np.frombuffer(row.norms, "<f4"))
        if state is not None:
            yield told()

    lots = lots_of(n_pages)
    every = index.select("page", "codes", "norms").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("turn", F.lit(0.0))
    lists = in_cells(queries, every, ["codes", "norms"], lots).mapInPandas(search, "cell long, width int, scores binary, places binary")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, q = np.frombuffer(row.ids, "<i8"), matrix_of(row.data, dim)
                state = Shortlist(model, near(q), most)
                for part in sorted(row.lists, key=lambda p: p["cell"]):
                    state.add(np.frombuffer(part["scores"], "<f4").reshape(len(ids), -1), np.frombuffer(part["places"], "<i8").reshape(len(ids), -1))
                who, place = np.repeat(np.arange(len(ids)), state.place.shape[1]), state.place.reshape(-1)
                order = np.argsort(place, kind="stable")
                who, place = who[order], place[order]
                cuts = np.flatnonzero(np.diff(place // PLACES)) + 1
                for w, p in zip(np.split(who, cuts), np.split(place, cuts)):
                    named, number = np.unique(w, return_inverse=True)
                    yield pd.DataFrame([{"page": int(p[0] // PLACES), "q_ids": ids[named].tobytes(), "q_data": q[named].tobytes(), "who": number.reshape(-1).astype("<i4").tobytes(), "codes": (p % PLACES).astype("<i4").tobytes()}])

    gathered = lists.groupBy(F.floor(F.col("cell") / lots).alias("block")).agg(F.collect_list(F.struct("cell", "scores", "places")).alias("lists"))
    wanted = gathered.join(queries, "block").mapInPandas(merge, "page long, q_ids binary, q_data binary, who binary, codes binary")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, begin, data = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.begin, "<i8"), matrix_of(row.data, dim)
                kind = np.unique(np.frombuffer(row.own_codes, np.uint8).reshape(-1, books), axis=0, return_inverse=True)[1].reshape(-1)
                by_kind = np.argsort(kind, kind="stable")
                at = np.concatenate([[0], np.cumsum(np.bincount(kind))])
                q_ids, q = np.frombuffer(row.q_ids, "<i8"), matrix_of(row.q_data, dim)
                pair, entry = expand(np.frombuffer(row.codes, "<i4").astype(np.int64), at)
                who, entry = np.frombuffer(row.who, "<i4")[pair], by_kind[entry]
                near = np.concatenate([np.sqrt(((data[entry[i : i + 65_536]] - q[who[i : i + 65_536]]) ** 2).sum(axis=1)) for i in range(0, len(who), 65_536)])
                pair, flat = expand(entry, begin)
                other = ids[flat] != q_ids[who[pair]]
                who, score, found, _ = first_of_each(who[pair][other], near[pair][other], ids[flat][other], k)
                yield pd.DataFrame({"query_id": q_ids[who], "vec_id": found, "score": score})

    beside = wanted.join(index.select("page", "ids", "begin", "data", F.col("codes").alias("own_codes")), "page")
    listed = keep(best(beside.mapInPandas(exact, "query_id long, vec_id long, score double"), k, F.asc("score")), "listed")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lot, held = None, []
        for batch in batches:
            for row in batch.itertuples():
                if row.lot != lot:
                    lot, held = row.lot, []
                if row.turn == 0:
                    codes = np.frombuffer(row.codes, np.uint8).reshape(-1, books)
                    held.append((codes, np.frombuffer(row.errors, "<f8"), matrix_of(row.data, dim), np.frombuffer(row.ids, "<i8"), np.frombuffer(row.begin, "<i8")))
                    continue
                ids, q = np.frombuffer(row.ids, "<i8"), matrix_of(row.data, dim)
                state = Nearest(ids, q, centred(q), np.frombuffer(row.radius, "<f8").copy(), scale, k)
                for codes, *rest in held:
                    state.page(exact_words.decode(codes), *rest)
                who, score, found = state.found
                yield pd.DataFrame({"query_id": ids[who], "vec_id": found, "score": score})

    def radii(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, radius = np.frombuffer(row.ids, "<i8"), np.full(len(row.ids) // 8, np.inf)
                known = np.array([(p["query_id"], p["score"]) for p in row.ends], [("id", "<i8"), ("score", "<f8")])
                radius[np.searchsorted(ids, known["id"])] = known["score"]
                yield pd.DataFrame([{"block": row.block, "ids": row.ids, "data": row.data, "radius": radius.tobytes()}])

    # the queries go to the lots of pages, so an original vector is moved once
    ends = listed.where(F.col("rank") == k).groupBy(F.pmod(F.xxhash64("query_id", F.lit(9)), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "score")).alias("ends"))
    known = queries.join(ends, "block", "left").withColumn("ends", F.coalesce("ends", F.array().cast("array<struct<query_id:bigint,score:double>>")))
    bounded = known.mapInPandas(radii, "block long, ids binary, data binary, radius binary")
    n_lots = max(min(n_pages, 8), -(-n_pages // LOT_PAGES))
    none = F.lit(None).cast("binary")
    held = index.select(F.pmod("page", F.lit(n_lots)).alias("lot"), F.lit(0).alias("turn"), F.col("page").alias("at"), "ids", "begin", "data", "codes", "errors", none.alias("radius"))
    asking = bounded.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lots - 1).cast("long"))).alias("lot"), F.lit(1).alias("turn"), F.col("block").alias("at"), "ids", none.alias("begin"), "data", none.alias("codes"), none.alias("errors"), "radius")
    cells = held.unionByName(asking).repartition("lot").sortWithinPartitions("lot", "turn", "at")
    return best(cells.mapInPandas(settle, "query_id long, vec_id long, score double"), k, F.asc("score"))
