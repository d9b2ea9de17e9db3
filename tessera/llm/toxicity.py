"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import is_held_out
from tessera.session import keep

# A small seed lexicon of insults and the second-person words, in four languages.
SEED = frozenset("idiot moron stupid dumb pathetic loser worthless disgusting trash scum dumm dämlich trottel versager abschaum imbécile débile connard minable estúpido imbécil asqueroso basura inútil".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes tus".split())
LEET = str.maketrans("013457@$!*", "oieastasi_")

WORDS = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)*")
FEATURES = (
    "log_words", "word_length", "seed_hits", "seed_rate", "learned_hits", "learned_distinct", "learned_sum", "learned_max", "learned_rate", "hidden_hits",
    "second_rate", "near_hits", "nearest", "upper_rate", "upper_words", "exclaim", "question", "symbols", "digits", "punctuation", "runs", "mixed_rate", "lines",
)
_UPPER, _LOWER, _DIGIT, _EXCLAIM, _QUESTION, _SYMBOL, _PUNCT, _LINE, _OTHER = range(9)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(1 << 16, _OTHER, dtype=np.uint8)
    for u in range(1 << 16):
        c = chr(u)
        if c.isalpha():
            out[u] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            out[u] = _DIGIT
    for chars, k in (("!", _EXCLAIM), ("?", _QUESTION), ("*@#$%&_~^", _SYMBOL), (".,;:-'\"()", _PUNCT), ("\n", _LINE)):
        for c in chars:
            out[ord(c)] = k
    return out


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The dense features of a whole text; an empty or null one has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    kind = _classes()[units]
    n = np.bincount(kind, minlength=9)
    size, letters = len(units), max(1, int(n[_UPPER] + n[_LOWER]))
    same = (units[2:] == units[1:-1]) & (units[1:-1] == units[:-2]) & (kind[2:] <= _LOWER)
    words = WORDS.findall(text.lower())
    m = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon or w in SEED]
    seeds = sum(words[i] in SEED for i in hits)
    held = [lexicon[words[i]] for i in hits if words[i] in lexicon]
    second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], dtype=np.int64)
    near, nearest = 0, 0.0
    if len(second) and hits:
        at = np.array(hits)
        j = np.searchsorted(second, at)
        gap = np.minimum(np.abs(at - second[np.minimum(j, len(second) - 1)]), np.abs(at - second[np.maximum(j - 1, 0)]))
        near, nearest = int((gap <= 5).sum()), 1 / (1 + float(gap.min()))
    hidden = mixed = 0
    if n[_DIGIT] or n[_SYMBOL] or n[_EXCLAIM]:
        for w in MIXED.findall(text):
            plain = w.lower().translate(LEET)
            mixed += 1
            hidden += plain in lexicon or plain in SEED
    shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) if n[_UPPER] > 2 else 0
    return [
        np.log1p(len(words)), letters / m, seeds, seeds / m, len(held), len({words[i] for i in hits}), sum(held), max(held, default=0.0), sum(held) / m, hidden,
        len(second) / m, near, nearest, n[_UPPER] / letters, shouted / m, n[_EXCLAIM] / m, n[_QUESTION] / m, n[_SYMBOL] / m, n[_DIGIT] / size, n[_PUNCT] / m, same.sum() / size, mixed / m, n[_LINE] / m,
    ]


@dataclass
class Boosted:
    """Trees of fixed depth over binned features, as flat arrays, and a calibration curve."""

    edges: list[np.ndarray]
    depth: int
    base: float
    split: np.ndarray  # trees x inner nodes: feature
    cut: np.ndarray  # trees x inner nodes: go right if bin > cut
    leaf: np.ndarray  # trees x leaves
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for t in range(len(self.split)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, self.split[t, node]] > self.cut[t, node])
            out += self.leaf[t, node - (1 << self.depth) + 1]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-self.raw(x)))
        if self.curve is None:
            return p
        # the curve is flat in places: a thousandth of the uncalibrated score keeps the order there
        return 0.999 * np.interp(p, *self.curve) + 0.001 * p


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, ridge: float = 2.0, least: float = 2.0) -> Boosted:
    """Second-order boosting on the log loss with histogram splits."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    prior = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-4), 1 - 1e-4)
    inner, leaves = (1 << depth) - 1, 1 << depth
    model = Boosted(edges, depth, float(np.log(prior / (1 - prior))), np.zeros((rounds, inner), np.int64), np.full((rounds, inner), 1 << 30), np.zeros((rounds, leaves)))
    b = model.bins(x)
    width = bins + 1
    flat = b + np.arange(x.shape[1]) * width
    out = np.full(len(y), model.base)
    rows = np.arange(len(y))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-out))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for d in range(depth):
            for k in range((1 << d) - 1, (2 << d) - 1):
                own = np.flatnonzero(node == k)
                if len(own) < 2:
                    continue
                at = flat[own].ravel()
                gs = np.bincount(at, np.repeat(g[own], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(axis=1)
                hs = np.bincount(at, np.repeat(h[own], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(axis=1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                gain[(hs < least) | (total_h - hs < least)] = 0
                f, c = divmod(int(gain.argmax()), width)
                if gain[f, c] > 1e-6:
                    model.split[t, k], model.cut[t, k] = f, c
            node = 2 * node + 1 + (b[rows, model.split[t, node]] > model.cut[t, node])
        at = node - inner
        model.leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        out += model.leaf[t, at]
    return model


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The least-squares non-decreasing curve of y over p, by pooling adjacent violators."""
    if len(y) < 20 or y.min() == y.max():
        return None
    order = np.argsort(p, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of p
    for a, b in zip(p[order], y[order]):
        pools.append([float(b), 1.0, float(a)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    return np.array([s / n for _, n, s in pools]), np.array([s / n for s, n, _ in pools])


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Boosted | None

    def score(self, texts: pd.Series) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.zeros(len(texts))
        return np.clip(self.trees.score(np.array([features(t, self.lexicon) for t in texts], dtype=np.float64)), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, lexicon_words: int = 500) -> ToxicityModel:
    """Learn from at most ``sample_rows`` labelled documents that are not held out, picked by hash.

    Word counts by label are added up on the executors and ranked there; only the ``lexicon_words`` most
    telling words come to the driver, then the sample's features: one row for each id, so repeated ids don't enlarge it.
    Rows with crc32 mod 5 of 4 only calibrate.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(sample_rows)
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).cast("int")
    # of a repeated id one row: the sample is bounded by rows, whatever an id's copies
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "toxic")).alias("one"))
    rows = keep(own.select("one.text", "one.toxic", fold.alias("fold")), "toxicity")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        n = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[toxic].update(set(WORDS.findall(text.lower())))
                n[toxic] += 1
        words = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame([("", n[1], n[0]), *((w, seen[1][w], seen[0][w]) for w in words)], columns=["word", "bad", "good"])

    totals = keep(rows.where("fold <> 4").select("text", "toxic").mapInPandas(counts, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad >= 2 OR word = ''"), "words")
    base = totals.where("word = ''").first()
    lexicon: dict[str, float] = {}
    if base is not None and base.bad and base.good:
        odds = F.log((F.col("bad") + 0.5) / (base.bad + 1.0)) - F.log((F.col("good") + 0.5) / (base.good + 1.0))
        sure = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        top = totals.where("word <> ''").withColumn("odds", odds).withColumn("sure", sure).where("sure > 3.3").orderBy(F.desc("sure"), "word").limit(lexicon_words)
        lexicon = {r.word: float(r.odds) for r in top.collect()}

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "fold": batch["fold"], "x": [list(map(float, features(t, lexicon))) for t in batch["text"]]})

    got = rows.mapInPandas(dense, "toxic int, fold int, x array<double>").toPandas()
    if not len(got):
        return ToxicityModel(lexicon, None)
    x, y, fold_of = np.array(got["x"].tolist()), got["toxic"].to_numpy(dtype=np.float64), got["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold_of))
    x, y, fold_of = x[order], y[order], fold_of[order]
    learn = fold_of != 4 if (fold_of != 4).any() else np.ones(len(y), bool)
    trees = boost(x[learn], y[learn])
    trees.curve = isotonic(1 / (1 + np.exp(-trees.raw(x[~learn]))), y[~learn]) if (~learn).any() else None
    return ToxicityModel(lexicon, trees)


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """The calibrated score of a text, 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(batch))

    return run(text.cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, **options: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; the model is fitted if not given.

    Null and empty texts are scored as having no words. Without labels every score is 0. A null id counts as
    held out; repeated rows are scored alike; conflicting labels of an id count as toxic; extra columns are ignored.
    """
    model = model or fit(docs, labels, **options)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
