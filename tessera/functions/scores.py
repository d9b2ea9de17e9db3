"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.model import CONFIDENCE, DAY_MS, HALF_LIFE_DAYS, LAYER_WEIGHT, OTHER_CONFIDENCE, OTHER_HALF_LIFE

K1, B = 1.2, 0.75
MAX_DISTANCE = 0.75


def idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, doc_len: Column, mean_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / mean_len))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def clamp_distance(d: Column | float | None) -> Column:
    """A cosine distance bound: at most 2, by default 0.75."""
    return F.lit(MAX_DISTANCE) if d is None else F.least(F.lit(d) if isinstance(d, (int, float)) else d, F.lit(2.0))


def half_life(layer: Column) -> Column:
    """Days; null means no decay."""
    out = F.when(layer == "semantic", F.lit(None).cast("double"))
    for name, days in HALF_LIFE_DAYS.items():
        out = out.when(layer == name, F.lit(float(days)))
    return out.otherwise(F.lit(float(OTHER_HALF_LIFE)))


def decay(layer: Column, created_ms: Column, now_ms: Column) -> Column:
    """0.5 to the power of age over half-life; the age is at least 0 and semantic rows don't age."""
    age = F.greatest(F.lit(0.0), (now_ms - created_ms) / float(DAY_MS))
    return F.coalesce(F.pow(F.lit(0.5), age / half_life(layer)), F.lit(1.0))


def age_days(created_ms: Column, now_ms: Column) -> Column:
    return F.floor((now_ms - created_ms) / DAY_MS).cast("long")


def layer_weight(layer: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LAYER_WEIGHT.items() for x in kv]), layer)


def confidence_value(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), label), F.lit(OTHER_CONFIDENCE))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct values; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """low and high of the score interval, in percent rounded to whole numbers."""
    p = hits / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    bound = lambda c: F.round(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).cast("int")
    return F.struct(bound(mid - half).alias("low"), bound(mid + half).alias("high"))


def word_score(terms: Column, name: Column, path: Column) -> Column:
    """How well a question's words fit a declaration: 1 each in its name, 0.4 in its path, 0.5 as a prefix of a name word or the reverse."""

    def one(t: Column) -> Column:
        near = F.exists(name, lambda p: p.startswith(t) | t.startswith(p))
        return F.when(F.array_contains(name, t), 1.0).when(F.array_contains(path, t), 0.4).when(near, 0.5).otherwise(0.0)

    return F.round(F.aggregate(terms, F.lit(0.0), lambda s, t: s + one(t)) / F.greatest(F.size(terms), F.lit(1)), 4)
