"""Exact ranks over a whole table, with no task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import keep

#: Rows of a partition are numbered below this.
WIDTH = 1 << 33


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in a total order.

    Rows are dealt to partitions by ranges of the order, sorted there and written with their numbers; a row's place is its number plus what the partitions before it
    hold. Those counts, one for each partition, are all that comes to the driver. Rows that tie in the whole order are numbered as they lie.
    """
    lie = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("lies_at", F.monotonically_increasing_id()), "ranked")
    counts = {r.part: r.n for r in lie.groupBy(F.floor(F.col("lies_at") / WIDTH).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for part in sorted(counts):
        before.append((part, at))
        at += counts[part]
    table = rows.sparkSession.createDataFrame(before, "lies_in long, before long")
    placed = lie.withColumn("lies_in", F.floor(F.col("lies_at") / WIDTH)).join(F.broadcast(table), "lies_in")  # a row for each partition
    return placed.withColumn(name, F.col("before") + F.pmod("lies_at", F.lit(WIDTH)) + 1).drop("lies_in", "lies_at", "before")
