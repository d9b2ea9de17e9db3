"""The journal as a stream: session files appended by many writers, merged into the store batch by batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.model import JOURNAL, MEMORY, MEMORY_EDGE
from tessera.plans.store import Store, merge_journal

#: Where a line that is not an entry is kept.
BAD = "bad_line"
WAITING = T.StructType([T.StructField(name, kind) for name, kind in (("src", T.StringType()), ("dst", T.StringType()), ("type", T.StringType()), ("weight", T.DoubleType()), ("at", T.LongType()))])


def read_journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """Entries, and in ``bad_line`` the text of lines that are none."""
    return spark.readStream.schema(T.StructType([*JOURNAL.fields, T.StructField(BAD, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def _bad_lines_of(store: Store, checkpoint: str) -> str:
    return f"{store.root}/bad_lines/{hashlib.sha1(checkpoint.encode()).hexdigest()}"


def bad_lines(store: Store, checkpoint: str) -> DataFrame:
    """batch, line: every line of the stream that was not an entry."""
    return store.spark.read.schema("line string, batch long").parquet(_bad_lines_of(store, checkpoint))


def waiting_edges(store: Store) -> DataFrame:
    """Edges of the journal that have an end without a node so far."""
    return store.read("waiting_edge") if store.has("waiting_edge") else store.spark.createDataFrame([], WAITING)


def merge_stream(store: Store, path: str, checkpoint: str) -> int:
    """Merge what has arrived since the last call and stop; returns the store's write_seq.

    An edge whose ends are not both there waits in a table of its own and is offered again with each batch, so it is linked when its node comes, however
    late, and by a join: a node that a third of all edges wait for is no group. Of an id the first node counts, of an edge the earliest. Lines that are not
    entries, and edges without an end or a type, are kept by batch (``bad_lines``). The store remembers the last batch it merged for a
    checkpoint, so a batch that is replayed after a crash is not merged twice, and merging is idempotent besides.
    """

    def apply(batch: DataFrame, number: int) -> None:
        done = store.meta().get("merged", {})
        if number <= done.get(checkpoint, -1):
            return
        spark = batch.sparkSession
        broken = F.col("kind").isNull() | ((F.col("kind") == "edge") & (F.col("edge.src").isNull() | F.col("edge.dst").isNull() | F.col("edge.type").isNull())) | ((F.col("kind") == "node") & F.col("node.id").isNull())
        line = F.when(F.col(BAD).isNotNull(), F.col(BAD)).when(F.coalesce(broken, F.lit(True)), F.to_json(F.struct("kind", "at", "node", "edge")))
        told = batch.withColumn("line", line)
        told.where("line IS NOT NULL").select("line").write.mode("overwrite").parquet(f"{_bad_lines_of(store, checkpoint)}/batch={number}")
        memory = store.read("memory") if store.has("memory") else spark.createDataFrame([], MEMORY)
        edges = store.read("memory_edge") if store.has("memory_edge") else spark.createDataFrame([], MEMORY_EDGE)
        again = waiting_edges(store).select(F.lit("edge").alias("kind"), "at", F.lit(None).cast(JOURNAL["node"].dataType).alias("node"), F.struct("src", "dst", "type", "weight").cast(JOURNAL["edge"].dataType).alias("edge"))
        merged, linked, dropped = merge_journal(memory, edges, told.where("line IS NULL").select(*JOURNAL.names).unionByName(again))
        left = dropped.select("src", "dst", "type", "weight", F.col("created_at").alias("at"))
        store.commit({"memory": merged, "memory_edge": linked, "waiting_edge": left}, merged={**done, checkpoint: number})

    query = read_journal_stream(store.spark, path).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.meta()["write_seq"]
