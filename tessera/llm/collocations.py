"""Phrase collocations: frequent phrases by hashed bucket counts and Apriori pruning, exact counts, exact scores."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import keep

UNKNOWN = "und"
#: Bytes of a text: A-Z lower-cased, tab as space, the marks that end a piece as 255, which UTF-8 never holds.
GAP = 255
FOLDED = bytes(GAP if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
PARTIAL = "lang string, phrase string, n long, section int, data binary"
ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("section", pa.int32()), ("data", pa.binary())])
RANGES = 256


class Buckets:
    """A task's counts of hashed things, up to 255 each: adding them up tells exactly which buckets reach a threshold of at most 255."""

    def __init__(self, bits: int):
        self.shift, self.count = np.uint64(64 - bits), np.zeros(1 << bits, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        if len(hashes):
            at, n = np.unique(hashes >> self.shift, return_counts=True)
            self.count[at] = np.minimum(255, self.count[at] + n)

    def batch(self) -> pa.RecordBatch:
        parts = self.count.reshape(RANGES, -1)
        used = np.flatnonzero(parts.any(axis=1))
        none = pa.nulls(len(used), pa.string())
        return pa.record_batch([none, none, pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i], 1) for i in used], pa.binary())], ROWS)


def bitmap(counts: DataFrame, bits: int, least: int) -> Broadcast:
    """One bit for each bucket whose count over all tasks is at least ``least``: 2^bits bits, whatever the input.

    Sections of the tasks' counts are added up as they stream by, one section at a time.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for batch in batches:
            for section, data in zip(batch["section"], batch["data"]):
                if section != now:
                    if now is not None:
                        yield pd.DataFrame({"section": [now], "data": [np.packbits(total >= least).tobytes()]})
                    now, total = section, np.zeros((1 << bits) // RANGES, np.uint16)
                total = np.minimum(255, total + np.frombuffer(zlib.decompress(data), np.uint8))
        if now is not None:
            yield pd.DataFrame({"section": [now], "data": [np.packbits(total >= least).tobytes()]})

    parts = counts.where("data IS NOT NULL").select("section", "data").repartition("section").sortWithinPartitions("section").mapInPandas(add, "section int, data binary")
    whole = np.zeros((RANGES, (1 << bits) // RANGES // 8), np.uint8)
    for row in parts.collect():
        whole[row.section] = np.frombuffer(row.data, np.uint8)
    return counts.sparkSession.sparkContext.broadcast(whole.reshape(-1))


def has(bits_of: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bits_of[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Chunk:
    """The words of some texts of one language in reading order, as numbers of distinct words; -1 where a piece ends."""

    def __init__(self, lang: str, texts: list[bytes]):
        marks = (bytes([GAP]) + b" " + bytes([GAP])).join(texts).translate(FOLDED).replace(bytes([GAP]), b" \xff ")
        known: dict[bytes, int] = defaultdict(lambda: len(known) - 1)
        known[b"\xff"] = -1
        words = marks.split()
        self.at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.lang, self.words = lang, list(known)[1:]
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hash = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)

    def runs(self, length: int) -> np.ndarray:
        """Where ``length`` words of one piece begin."""
        inside = np.flatnonzero(self.at >= 0)
        for k in range(1, length):
            inside = inside[inside + k < len(self.at)]
            inside = inside[self.at[inside + k] >= 0]
        return inside

    def hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        out = self.hash[self.at[starts]]
        for k in range(1, length):
            out = mixed(out, self.hash[self.at[starts + k]])
        return out

    def counts(self, codes: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        """Rows of phrases, given by their words' numbers, and counts."""
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        phrase = words.take(pa.array(codes[0])) if len(codes) == 1 else pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in codes), " ")
        return pa.record_batch([pa.repeat(self.lang, len(n)), phrase, pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ROWS)

    def phrases(self, starts: np.ndarray, length: int) -> pa.RecordBatch:
        """The distinct phrases of these places with their counts; told apart by their words, not by their hashes."""
        total, codes = max(1, len(self.words)), [self.at[starts + k] for k in range(length)]
        key = codes[0]
        for code in codes[1:-1]:
            key = np.unique(key * total + code, return_inverse=True)[1].reshape(-1)
        _, first, n = np.unique(key * total + codes[-1], return_index=True, return_counts=True)
        return self.counts([c[first] for c in codes], n)


def chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[Chunk]:
    """Texts of a language together, about ``most`` bytes at a time; a longer text is a chunk of its own."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            data = text.as_py()
            held[lang].append(data)
            size += len(data)
            if size > most:
                yield from (Chunk(key, texts) for key, texts in held.items())
                held.clear()
                size = 0
    yield from (Chunk(key, texts) for key, texts in held.items())


def counted(texts: DataFrame, each: Callable[[Chunk, Buckets], pa.RecordBatch], bits: int, name: str) -> DataFrame:
    """One reading of all texts: rows of exact partial counts, and each task's bucket counts of the next length. Kept, as both are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits)
        for chunk in chunks(batches):
            yield each(chunk, buckets)
        yield buckets.batch()

    return keep(texts.mapInArrow(run, PARTIAL), name)


def frequent(rows: DataFrame, least: int) -> DataFrame:
    return rows.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def marked(found: DataFrame, length: int, bits: int) -> Broadcast:
    """A bitmap of the hashes of phrases that are frequent: what is not in it needs no counting at the next length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets(bits)
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch["lang"], batch["phrase"])):
                seed = xxhash.xxh3_64_intdigest(lang.encode())
                words = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")], np.uint64)
                out[i] = words[0] if length == 1 else mixed(words[:1], words[1:2])[0]
            buckets.add(out)
        yield buckets.batch().to_pandas()

    return bitmap(found.select("lang", "phrase").mapInPandas(run, PARTIAL), bits, 1)


def part(start: int, length: int | None = None) -> Column:
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, start, F.lit(length) if length else F.size(words) - start + 1), " ")


def top(rows: DataFrame, most: int, lots: int = 64) -> DataFrame:
    """Each lang's first ``most``; first in ``lots`` parts of it, so that no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase").cast("binary")]
    some = rows.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(lots)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("lot")


def mine(docs: DataFrame, *, least: int = 10, most: int = 2000, inside_percent: int = 50, bits: int = 26, hot_share: int = 1000) -> DataFrame:
    """Phrases of two and three words that occur at least ``least`` times in a language, by how little their parts explain them.

    Three readings of the texts. The first counts words, and two-word phrases in 2^bits hashed buckets. The second counts exactly those
    two-word phrases whose words are frequent and whose bucket is, and three-word phrases in buckets; the third exactly those
    three-word phrases whose two-word parts are frequent and whose bucket is. What is broadcast are bitmaps of 2^bits bits (8 MB): of buckets and of
    hashes of frequent phrases. A bit that is set wrongly costs a count, never a result, since counts are by words; with far more phrases than
    buckets the buckets prune little, and the frequent parts do what is left. Counts are
    added up in the tasks before they are shuffled, so a hot word is one row a task.

    A phrase's score is the least, over its cuts, of 10^6 a^2 / (l r), rounded down, in decimals of 38 places: exact for counts below 10^15.
    The few parts with more than a ``hot_share``-th of all words (at most that many of each length) meet their phrases by
    broadcast, the rest by a shuffle. A two-word phrase inside a three-word one of at least ``inside_percent`` of its count is dropped.

    Null texts are empty and give nothing; a null lang is ``und`` (with rows whose lang is that); repeated rows count each; long texts are
    read whole; ties go to the phrase of smaller bytes; ``least`` is at most 255; extra columns are ignored; an empty table gives no rows.
    """
    if not 1 <= least <= 255:
        raise ValueError("least is from 1 to 255")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")

    def first(chunk: Chunk, buckets: Buckets) -> pa.RecordBatch:
        buckets.add(chunk.hashes(chunk.runs(2), 2))
        return chunk.counts([np.arange(len(chunk.words))], np.bincount(chunk.at[chunk.at >= 0], minlength=len(chunk.words)))

    ones = counted(texts, first, bits, "words")
    words = keep(frequent(ones, least), "frequent-words")
    totals = ones.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    full, known = bitmap(ones, bits, least), marked(words, 1, bits)

    def second(chunk: Chunk, buckets: Buckets) -> pa.RecordBatch:
        often = has(known.value, bits, chunk.hash) if len(chunk.hash) else np.zeros(0, bool)
        starts = chunk.runs(2)
        starts = starts[often[chunk.at[starts]] & often[chunk.at[starts + 1]]]
        starts = starts[has(full.value, bits, chunk.hashes(starts, 2))]
        able = np.zeros(len(chunk.at) + 1, bool)
        able[starts] = True
        buckets.add(chunk.hashes(starts[able[starts + 1]], 3))
        return chunk.phrases(starts, 2)

    twos = counted(texts, second, bits, "pairs")
    pairs = keep(frequent(twos, least), "frequent-pairs")
    full_3, known_2 = bitmap(twos, bits, least), marked(pairs, 2, bits)

    def third(chunk: Chunk) -> pa.RecordBatch:
        starts = chunk.runs(2)
        able = np.zeros(len(chunk.at) + 1, bool)
        able[starts[has(known_2.value, bits, chunk.hashes(starts, 2))]] = True
        starts = np.flatnonzero(able[:-1] & able[1:])
        return chunk.phrases(starts[has(full_3.value, bits, chunk.hashes(starts, 3))], 3)

    threes = keep(frequent(texts.mapInArrow(lambda batches: map(third, chunks(batches)), PARTIAL), least), "frequent-triples")

    # the parts a phrase is measured by, each a row
    pair_parts = F.array(F.struct(F.lit(0).alias("place"), part(1, 1).alias("part")), F.struct(F.lit(1).alias("place"), part(2).alias("part")))
    triple_parts = F.array(*(F.struct(F.lit(i).alias("place"), p.alias("part")) for i, p in enumerate([part(1, 1), part(2), part(1, 2), part(3)])))
    phrases = pairs.withColumn("parts", pair_parts).unionByName(threes.withColumn("parts", triple_parts)).withColumnRenamed("f", "a")
    needs = phrases.select("lang", "phrase", "a", F.inline("parts"))
    parts = words.unionByName(pairs).withColumnRenamed("phrase", "part")
    n_all = totals.agg(F.sum("n")).first()[0] or 0
    hot = parts.where(F.col("f") * hot_share > F.lit(n_all)).select("lang", "part", F.col("f").alias("hot"))
    cold = parts.where(F.col("f") * hot_share <= F.lit(n_all))
    told = needs.join(F.broadcast(hot), ["lang", "part"], "left")
    measured = told.where("hot IS NOT NULL").select("lang", "phrase", "a", "place", F.col("hot").alias("f")).unionByName(told.where("hot IS NULL").join(cold, ["lang", "part"]).select("lang", "phrase", "a", "place", "f"))
    sides = [F.max(F.when(F.col("place") == i, F.col("f"))).alias(f"p{i}") for i in range(4)]

    def score(left: str, right: str) -> Column:
        whole = [F.col(c).cast("decimal(15,0)") for c in ("a", left, right)]
        return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole[0] * whole[0]), whole[1] * whole[2])

    cut = F.struct(score("p0", "p1").alias("score"), F.lit(1).alias("k"), F.col("p0").alias("l"), F.col("p1").alias("r"))
    other = F.struct(score("p2", "p3").alias("score"), F.lit(2).alias("k"), F.col("p2").alias("l"), F.col("p3").alias("r"))
    scored = measured.groupBy("lang", "phrase", "a").agg(*sides).withColumn("cut", F.when(F.col("p2").isNull(), cut).otherwise(F.least(cut, other)))
    longer = threes.select("lang", F.explode(F.array(part(1, 2), part(2))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    ranked = top(left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same for DuckDB, over all pieces at once.
SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM piece
), runs AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL
), candidates AS (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, x.k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM candidates c JOIN counts x ON x.lang = c.lang AND x.k < c.size AND x.phrase = array_to_string(c.w[1 : x.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.k = c.size - x.k AND y.phrase = array_to_string(c.w[x.k + 1 : c.size], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM candidates WHERE size = 3 UNION ALL
    SELECT lang, a, array_to_string(w[2:3], ' ') AS phrase FROM candidates WHERE size = 3) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang)
SELECT p.lang, row_number() OVER (PARTITION BY p.lang ORDER BY p.score DESC, p.a DESC, encode(p.phrase)) AS rank, p.phrase, p.a, p.l, p.r, n.n, p.score
FROM lowest p JOIN n ON n.lang = p.lang LEFT JOIN longer g ON g.lang = p.lang AND g.phrase = p.phrase AND p.size = 2
WHERE g.a IS NULL OR 100 * g.a < 50 * p.a
QUALIFY row_number() OVER (PARTITION BY p.lang ORDER BY p.score DESC, p.a DESC, encode(p.phrase)) <= 2000
"""
