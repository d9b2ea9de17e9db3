"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import word_count
from tessera.session import keep

MAX_REPEAT = 3
#: A source or shard of fewer blocks than this is too small for whole blocks.
LEAST_BLOCKS = 64


def water_fill(sizes: list[int], weights: list[float], repeat: int = MAX_REPEAT) -> list[float]:
    """Share sum(sizes) by weight; no share passes ``repeat`` times its size, the excess is reshared."""
    target, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        level = rest / sum(weights[i] for i in free)
        over = [i for i in sorted(free) if level * weights[i] > repeat * sizes[i]]
        if not over:
            for i in free:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = float(repeat * sizes[i])
            rest -= target[i]
            free.discard(i)
    return target


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Give ``seats`` to the highest quotients votes / (2 * won + 1), none above its cap.

    Starting from the rounded shares, seats are then added to the highest open quotients or taken
    from the lowest won ones: the same outcome as awarding one by one, in as many steps as there are
    parties rather than seats. Ties go to the earlier party.
    """
    total = sum(votes)
    seats = min(seats, sum(c for v, c in zip(votes, caps) if v > 0))
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    won = [min(c, math.floor(v * seats / total + 0.5)) for v, c in zip(votes, caps)]
    held = sum(won)
    if held < seats:
        heap = [(-v / (2 * w + 1), i) for i, (v, w, c) in enumerate(zip(votes, won, caps)) if w < c and v > 0]
        heapq.heapify(heap)
        while held < seats:
            _, i = heapq.heappop(heap)
            won[i] += 1
            held += 1
            if won[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    elif held > seats:
        heap = [(v / (2 * w - 1), -i) for i, (v, w) in enumerate(zip(votes, won)) if w > 0]
        heapq.heapify(heap)
        while held > seats:
            _, j = heapq.heappop(heap)
            won[-j] -= 1
            held -= 1
            if won[-j] > 0:
                heapq.heappush(heap, (votes[-j] / (2 * won[-j] - 1), j))
    return won


def _shard_quotas(lengths: DataFrame, lots: DataFrame) -> DataFrame:
    """src, shard, length, quota (in words): the seats of each lot of shards apportioned to its shards, lot by lot on the executors."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        n, unit = part["length"].tolist(), int(part["unit"].iloc[0])
        won = sainte_lague([float(x) for x in n], int(part["seats"].iloc[0]), [MAX_REPEAT * x // unit for x in n])
        return pd.DataFrame({"src": part["src"], "shard": part["shard"], "length": n, "quota": [w * unit for w in won]})

    return lengths.join(F.broadcast(lots), ["src", "lot"]).groupBy("src", "lot").applyInPandas(run, "src int, shard long, length long, quota long")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_block: int = 1024,
    rows_per_shard: int = 1024,
    seed: int = 17,
    carry: bool = False,
) -> DataFrame:
    """How many words of each document a mix of the corpus takes.

    Sources, by code point with null last, weigh ``weights`` in turn and share the corpus' own size;
    a source's target stops at three times its size. A source is dealt by a seeded hash into shards of
    about ``rows_per_shard`` rows and at least 64 blocks, so a hot source is many groups. Blocks of equal token count (a 4,096th of
    the corpus, ``max_block`` at most) are apportioned by the highest quotients: to sources, then to the source's lots of shards,
    then, on the executors, to a lot's shards. A source whose target is below 64 blocks takes its target in words, so
    however small it is, it doesn't change the others' blocks. A shard takes its
    quota as a run of blocks from a seeded place on the ring of its documents in seeded order, going
    round again for repeats. Two passes run: sizes, then positions. Totals of sources and of lots come to the driver;
    a source has as many lots as the root of its number of shards.

    Returns doc_id, size, source_size, target, taken, shard; with ``carry`` also ``doc``, a struct of
    all input columns. Null and empty texts have size 0 and take 0 (they lie in shards of their own, numbered below 0); a null
    source is a source of its own; repeated rows count each; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    picked = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")]
    base = docs.select(*picked, F.struct(*docs.columns).alias("doc")) if carry else keep(docs.select(*picked), "mix")

    seen = base.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    stats = sorted(((r.source, r.n, r["size"]) for r in seen), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, _, s in stats]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(stats))])
    block = max(1, min(max_block, sum(sizes) // 4096))
    units = [block if t >= LEAST_BLOCKS * block else 1 for t in target]
    rows = [max(1, math.ceil(n / rows_per_shard)) for _, n, _ in stats]
    shards = [max(1, min(r, s // (LEAST_BLOCKS * u))) for r, s, u in zip(rows, sizes, units)]
    lots = [math.isqrt(k - 1) + 1 for k in shards]

    facts = [(i, s[0], s[2], t, k, l, u, r) for i, (s, t, k, l, u, r) in enumerate(zip(stats, target, shards, lots, units, rows))]
    plan = spark.createDataFrame(facts, "src int, source string, source_size long, target double, shards long, lots long, unit long, spare long")
    shard = F.xxhash64("order", F.lit(seed + 1))
    dealt = (
        base.join(F.broadcast(plan), base.source.eqNullSafe(plan.source))
        .drop(plan.source)
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "tie"))
        .withColumn("shard", F.when(F.col("size") > 0, F.pmod(shard, F.col("shards"))).otherwise(-1 - F.pmod(shard, F.col("spare"))))
    )
    lengths = keep(dealt.where("size > 0").groupBy("src", "shard").agg(F.sum("size").alias("length"), F.first("unit").alias("unit"), F.first("lots").alias("lots")).withColumn("lot", F.pmod("shard", F.col("lots"))), "lengths")
    held = lengths.groupBy("src", "lot").agg(F.sum("length").alias("length"), F.sum(F.floor(MAX_REPEAT * F.col("length") / F.col("unit"))).alias("cap")).collect()
    by_source: dict[int, list] = {}
    for r in sorted(held, key=lambda r: (r.src, r.lot)):
        by_source.setdefault(r.src, []).append(r)
    caps = [sum(r.cap for r in by_source.get(i, [])) for i in range(len(stats))]
    large = [i for i, u in enumerate(units) if u == block]
    won = dict(zip(large, sainte_lague([target[i] for i in large], round(sum(target[i] for i in large) / block), [caps[i] for i in large])))
    won |= {i: min(caps[i], round(t)) for i, t in enumerate(target) if i not in won}
    seats = [(i, r.lot, q) for i, own in by_source.items() for r, q in zip(own, sainte_lague([float(r.length) for r in own], won[i], [r.cap for r in own]))]
    quota = _shard_quotas(lengths, spark.createDataFrame(seats, "src int, lot long, seats long"))

    line = W.partitionBy("src", "shard").orderBy("order", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    length, begin, end = F.greatest(F.coalesce("length", F.lit(1)), F.lit(1)), F.col("first"), F.col("first") + F.col("size")
    placed = (
        dealt.join(quota, ["src", "shard"], "left")
        .withColumn("first", F.sum("size").over(line) - F.col("size"))
        .withColumn("quota", F.coalesce("quota", F.lit(0)))
        .withColumn("rest", F.pmod(F.col("quota"), length))
        .withColumn("from", F.pmod(F.xxhash64(F.lit(seed + 2), "src", "shard"), F.ceil(length / F.col("unit"))) * F.col("unit"))
    )
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(end, hi) - F.greatest(begin, lo))
    until = F.col("from") + F.col("rest")
    taken = F.floor(F.col("quota") / length) * F.col("size") + overlap(F.col("from"), until) + overlap(F.lit(0), until - length)
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "shard", *(["doc"] if carry else []))
