"""Embeddings: the provider interface and the hashed one, which is fully relational."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import count_terms
from tessera.session import spread


@dataclass(frozen=True)
class Space:
    """Vectors are comparable only if all three agree."""

    model: str
    dims: int
    provider: str


class Provider(Protocol):
    space: Space

    def warmup(self) -> None: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def hash_embedding(docs: DataFrame, dims: int = 384, id_col: str = "id", text_col: str = "text", kind: str = "float", cancelled: float = 0.0) -> DataFrame:
    """id, embedding: each term adds 1 + ln(count), signed, to two buckets that its SHA-1 picks; then the vector is normalised.
    Its components are of ``kind``, float or double. Where all that is added cancels out, no direction is left and the buckets met are ``cancelled``
    (Arrow gives NaN as null).

    Terms are counted and placed inside the document, so nothing is shuffled; a text without terms has no vector.
    """

    number = np.float32 if kind == "float" else np.float64

    @F.pandas_udf(f"array<{kind}>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        runs: dict[str, list[str]] = {}
        spots: dict[str, tuple[int, int]] = {}
        for batch in batches:
            out = []
            for text in batch:
                _, counts = count_terms(text, runs)
                if not counts:
                    out.append(None)
                    continue
                at = []
                for t in counts:
                    found = spots.get(t)
                    if found is None:
                        d = hashlib.sha1(t.encode()).digest()
                        # a bucket with the sign minus lies in the second half
                        a, b = int.from_bytes(d[:4], "big") % dims, int.from_bytes(d[4:8], "big") % dims
                        found = spots[t] = (a if d[8] % 2 == 0 else a + dims, b if d[9] % 2 == 0 else b + dims)
                    at += found
                w = np.repeat(1 + np.log(np.fromiter(counts.values(), np.float64, len(counts))), 2)
                both = np.bincount(np.array(at), w, 2 * dims)
                v = both[:dims] - both[dims:]
                norm = np.sqrt(v @ v)
                out.append((v / norm if norm else np.where(np.bincount(np.array(at) % dims, minlength=dims) > 0, cancelled, 0.0)).astype(number))
                if len(spots) > 500_000:
                    spots.clear()
            yield pd.Series(out, dtype=object)

    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    return rows.select("id", place("text").alias("embedding")).where("embedding IS NOT NULL")


def with_provider(text: Column, provider: Provider) -> Column:
    """The vectors of a provider, loaded once per worker and called by batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider.warmup()
        for batch in batches:
            vectors = provider.embed(batch.fillna("").tolist())
            if any(len(v) != provider.space.dims for v in vectors):
                raise ValueError(f"the provider gave vectors of another width than {provider.space.dims}")
            yield pd.Series(vectors)

    return run(text)


def to_embed(memory: DataFrame, space: Space, force: bool = False) -> DataFrame:
    """Rows without a vector in the space."""
    same = (F.col("embedding_model") == space.model) & (F.col("embedding_dims") == space.dims) & (F.col("embedding_provider") == space.provider)
    return memory if force else memory.where(~F.coalesce(same, F.lit(False)) | F.col("embedding").isNull())
