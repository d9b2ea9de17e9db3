"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import is_held_out

BITS = 16
BINS = 1 << BITS
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each UTF-16 unit: its lower-case letter, or a space; and whether it is a letter."""
    lower, alpha = np.full(1 << 16, 32, dtype=np.uint32), np.zeros(1 << 16, dtype=bool)
    for u in range(1 << 16):
        if 0xD800 <= u < 0xE000:
            lower[u] = u  # half of a letter or symbol beyond the first plane
        elif (c := chr(u)).isalpha():
            alpha[u] = True
            low = c.lower()
            lower[u] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else u
    return lower, alpha


def has_letter(text: str, units: np.ndarray) -> bool:
    return bool(_letters()[1][units].any()) or any(c.isalpha() for c in text if c > "￿")


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash bins of a whole text's 1-, 2- and 3-grams and their counts; None if it has no letter."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    if not has_letter(text, units):
        return None
    c = _letters()[0][units]
    a, b = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77)
    two = a[:-1] + b[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + c[2:] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - BITS)
    one = (c * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)) >> shift
    counts = np.bincount(np.concatenate([one, two >> shift, three >> shift]), minlength=BINS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    """Class names, idf per bin, weights (bins x classes, mostly zero) and the temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BINS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(1e-12, math.sqrt(float(x @ x)))

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if text and self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        z = self.logits(*found) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def train_ftrl(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002, seed: int = 11) -> None:
    """Follow-the-regularised-leader with elastic-net penalties; weights that l1 holds at zero stay zero. A row's vector is made when it is its turn, never all at once."""
    k = len(model.langs)
    z, n = np.zeros((BINS + 1, k), np.float32), np.zeros((BINS + 1, k), np.float32)
    order = np.random.default_rng(seed)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, counts, y = rows[i]
            at, x = np.append(at, BINS), np.append(model.vector(at, counts), 1.0)
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
    w = weight(z, n)
    model.weights, model.bias = w[:BINS].astype(np.float32), w[BINS]


def calibrate(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature of least log loss on rows that were not trained on, by golden-section search."""
    if not rows:
        return
    logits, y = np.array([model.logits(at, c) for at, c, _ in rows]), np.array([r[2] for r in rows])

    def loss(log_t: float) -> float:
        s = logits / math.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, ratio = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    model.temperature = math.exp((a + b) / 2)


def fit(docs: DataFrame, *, sample_docs: int = 6000, least_docs: int = 20) -> LanguageModel:
    """Learn from the text and non-null lang of rows that are not held out.

    Document frequencies cover every such row: each task adds up its own and sends at most one row per
    bin. The classifier is fitted on about ``sample_docs`` rows, picked by hash in equal shares per
    language, of which each gets at least ``least_docs``; a fifth of the sample is kept for the temperature. Every
    language that occurs is learned, and counts in training are those of prediction, whatever their size.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = np.zeros(BINS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                if (found := grams(text)) is not None:
                    seen[found[0]] += 1
                    total += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bin": np.append(at, -1), "n": np.append(seen[at], total)})

    # of repeated rows one counts, so that the sample is of the size meant whatever is repeated
    counted = rows.select("lang", F.xxhash64("doc_id", "text")).distinct().groupBy("lang").count().collect()
    langs = sorted(r.lang for r in counted)
    df = rows.select("text").mapInPandas(frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(BINS + 1)
    seen[df["bin"].to_numpy(dtype=np.int64)] = df["n"].to_numpy()
    model = LanguageModel(langs, (np.log((1 + seen[-1]) / (1 + seen[:BINS])) + 1).astype(np.float32))
    if not langs:
        return model

    share = {r.lang: min(1.0, max(least_docs, sample_docs / len(langs)) / r["count"]) for r in counted}
    lookup = docs.sparkSession.createDataFrame(sorted(share.items()), "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(lookup), "lang").where(place < F.col("share")).dropDuplicates(["lang", "doc_id", "text"]).select("lang", "text", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(5)).alias("fold"))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text, fold in zip(batch["lang"], batch["text"], batch["fold"]):
                if (found := grams(text)) is not None:
                    out.append((lang, int(fold), found[0].astype("<u2").tobytes(), found[1].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "fold", "bins", "counts"])

    got = picked.mapInPandas(sparse, "lang string, fold int, bins binary, counts binary").toPandas()
    got = got.sort_values(["lang", "fold", "bins", "counts"], ignore_index=True)
    number = {name: i for i, name in enumerate(langs)}
    # views of what was collected, 6 bytes a bin
    data = [(np.frombuffer(b, "<u2"), np.frombuffer(c, "<u4"), number[lang], fold) for lang, fold, b, c in zip(got["lang"], got["fold"], got["bins"], got["counts"])]
    train_ftrl(model, [d[:3] for d in data if d[3]] or [d[:3] for d in data])
    calibrate(model, [d[:3] for d in data if not d[3]])
    return model


def predicted(text: Column, model: LanguageModel) -> Column:
    """A struct lang_pred, score for a text."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score"])

    return run(text.cast("string"))


def identify(docs: DataFrame, model: LanguageModel | None = None, **options: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; the model is fitted on ``docs`` if not given.

    A null text or one without a letter is ``und`` with score 0, and so is every text if there is nothing to
    learn from. A null id counts as held out; repeated rows are scored alike; extra columns are ignored.
    """
    model = model or fit(docs, **options)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")
