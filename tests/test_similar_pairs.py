"""Pairs of alike sets: a large class is many tasks."""

from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import memory


def test_pairs_of_a_large_class_are_dealt_out(spark):
    sets = spark.range(4_000).select("id", F.array(F.lit("alike"), F.lit("words")).alias("terms"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to broadcast
    try:
        counts = [r["count"] for r in memory.similar_pairs(sets, 0.6).groupBy(F.spark_partition_id().alias("at")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(counts) == 4_000 * 3_999 // 2
    assert max(counts) < sum(counts) / 2


def test_pairs_across_lists_equal_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(memory, "IN_A_LIST", 3)
    words = ["a b c", "a b c d", "a b", "x", "x y z", "x y z w", "q"]
    data = [(i, words[i * i % 7].split()) for i in range(60)]
    got = sorted((r.a, r.b, r.similarity) for r in memory.similar_pairs(spark.createDataFrame(data, "id long, terms array<string>"), 0.6).collect())
    value = lambda s, t: len(set(s) & set(t)) / len(set(s) | set(t))
    assert got == [(i, j, round(value(s, t), 6)) for (i, s), (j, t) in combinations(data, 2) if value(s, t) >= 0.6]
