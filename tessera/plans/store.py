"""Snapshots of tables behind one pointer, and the merges that make the next one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import DERIVED, SCHEMA_VERSION, TOKENIZER_VERSION
from tessera.operators.memory import without_links
from tessera.session import create_text, delete_file, read_text, replace_text


class Conflict(RuntimeError):
    """Another writer was first."""


class Store:
    """A folder, on any file system Spark writes to, of numbered snapshots. CURRENT names the one that counts; it is replaced in one step after all tables are written,
    and only then does write_seq move. Readers look it up once per question, so they see one snapshot whole.

    Tables that did not change are named again rather than copied.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def meta(self) -> dict:
        text = read_text(self.spark, f"{self.root}/CURRENT")
        return json.loads(text) if text else {"schema_version": SCHEMA_VERSION, "tokenizer_version": TOKENIZER_VERSION, "write_seq": 0, "tables": {}}

    def has(self, name: str) -> bool:
        return name in self.meta()["tables"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.meta()['tables'][name]}")

    def commit(self, tables: dict[str, DataFrame], drop: tuple[str, ...] = (), since: int | None = None, **facts) -> int:
        """Write tables as the next snapshot and point to it; returns its write_seq.

        Each write_seq is claimed by a file that only one writer can make, before CURRENT moves: of two writers that started from the same
        snapshot (``since``, or the one found now) the later one gets a Conflict, and nothing of either is lost unseen.
        """
        meta = self.meta()
        if since is not None and since != meta["write_seq"]:
            raise Conflict(f"the store is at {meta['write_seq']}, not {since}")
        seq, at = meta["write_seq"] + 1, dict(meta["tables"])
        for name, df in tables.items():
            at[name] = f"v{seq}/{name}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.root}/{at[name]}")
        for name in drop:
            at.pop(name, None)
        if not create_text(self.spark, f"{self.root}/claims/{seq}", json.dumps(at)):
            raise Conflict(f"another writer made snapshot {seq}")
        replace_text(self.spark, f"{self.root}/CURRENT", json.dumps({**meta, **facts, "tables": at, "write_seq": seq}, indent=1))
        return seq

    def release(self, seq: int) -> None:
        """Give up the claim of a writer that died before its snapshot counted."""
        if seq > self.meta()["write_seq"]:
            delete_file(self.spark, f"{self.root}/claims/{seq}")

    def rebuild(self) -> int:
        """Forget what can be made again from files; what people recorded stays."""
        return self.commit({}, drop=DERIVED)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small file on any file system, written beside and renamed, so that a reader sees the old or the new, never half."""
    replace_text(spark, path, json.dumps(value, indent=1))


def upsert(memory: DataFrame, delta: DataFrame, now_ms: int) -> DataFrame:
    """Known ids are seen again (access_count, last_seen_at, the higher importance); new ones are added."""
    once = delta.dropDuplicates(["id"])
    again = once.select("id", F.col("importance").alias("new_importance"), F.lit(True).alias("again"))
    old = memory.join(again, "id", "left")
    bumped = old.select(
        *[
            F.when(F.col("again"), value).otherwise(F.col(c)).alias(c) if (value := {"access_count": F.col("access_count") + 1, "last_seen_at": F.lit(now_ms), "importance": F.greatest("importance", "new_importance")}.get(c)) is not None else F.col(c)
            for c in memory.columns
        ]
    )
    return bumped.unionByName(once.join(memory.select("id"), "id", "left_anti").select(*memory.columns))


def supersede(memory: DataFrame, gone: DataFrame, now_ms: int) -> DataFrame:
    """Mark rows superseded, once."""
    hit = gone.select("id").distinct().withColumn("hit", F.lit(True))
    return memory.join(hit, "id", "left").select(*[F.when(F.col("hit") & F.col("superseded_at").isNull(), F.lit(now_ms).cast("long")).otherwise(F.col(c)).alias(c) if c == "superseded_at" else F.col(c) for c in memory.columns])


def delete_nodes(memory: DataFrame, gone: DataFrame, *links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without the deleted ones, and the ids refused because a link touches them."""
    asked = gone.select("id").distinct()
    free = without_links(asked, *links)
    return memory.join(free, "id", "left_anti").select(*memory.columns), asked.join(free, "id", "left_anti")


def replace_files(table: DataFrame, fresh: DataFrame, files: DataFrame, file_col: str = "file_path") -> DataFrame:
    """A file's rows make way for its new ones."""
    return table.join(files.select(F.col("path").alias(file_col)).distinct(), file_col, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))


def stale_chunks(memory: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Live artifacts of re-read files that the new reading no longer has."""
    mine = memory.where("layer = 'artifact' AND superseded_at IS NULL").join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    return mine.join(fresh.select("id"), "id", "left_anti")


def restore_recorded(links: DataFrame, symbol: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recorded ABOUT links whose symbol exists again after a rebuild, and those that lost it."""
    ids = symbol.select(F.col("id").alias("symbol_id"))
    return links.join(ids, "symbol_id", "left_semi").select(*links.columns), links.join(ids, "symbol_id", "left_anti").select(*links.columns)


def merge_journal(memory: DataFrame, edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memory and edges with a journal's entries, and the edges dropped because an end is missing. Doing it twice changes nothing."""
    nodes = entries.where("kind = 'node' AND node.id IS NOT NULL").select("node.*", "at").withColumn("n", F.struct("at"))
    nodes = nodes.groupBy("id").agg(*[F.min_by(c, "at").alias(c) for c in ("layer", "title", "body", "source_ref", "importance", "created_at")])
    fresh = nodes.join(memory.select("id"), "id", "left_anti")
    full = fresh.select(*[F.col(c) if c in fresh.columns else (F.lit(0).cast("long") if c == "access_count" else F.lit(None).cast(t)).alias(c) for c, t in memory.dtypes])
    merged = memory.unionByName(full)
    first = F.min(F.struct(F.col("at").alias("created_at"), "edge.weight")).alias("first")
    asked = entries.where("kind = 'edge'").groupBy("edge.src", "edge.dst", "edge.type").agg(first).select("src", "dst", "type", "first.*")
    ids = merged.select("id")
    ok = asked.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    dropped = asked.join(ok.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    new = ok.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    return merged, edges.unionByName(new.select("src", "dst", "type", F.coalesce("weight", F.lit(1.0)).alias("weight"), "created_at", F.lit(None).cast("string").alias("evidence_ref")).select(*edges.columns)), dropped


def capabilities(spark: SparkSession, root: str) -> dict:
    """What a store at ``root`` can do here, by trying: feature -> status (ok or unavailable) and reason."""
    place = f"{root.rstrip('/')}/probe-{uuid.uuid4().hex[:8]}"

    def rename() -> None:
        replace_text(spark, f"{place}/a", "1")
        replace_text(spark, f"{place}/a", "2")
        assert read_text(spark, f"{place}/a") == "2", "a reader saw the old file"

    def claim() -> None:
        assert create_text(spark, f"{place}/b", "1") and not create_text(spark, f"{place}/b", "2"), "two writers made one file"

    def tables() -> None:
        spark.range(3).write.parquet(f"{place}/t")
        assert spark.read.parquet(f"{place}/t").count() == 3, "rows were lost"

    def arrow() -> None:
        assert spark.range(3).mapInPandas(lambda it: it, "id long").count() == 3, "rows were lost"

    def recursion() -> None:
        assert spark.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r").count() == 3, "rows were lost"

    found = {}
    for name, probe in (("atomic replace", rename), ("write lock", claim), ("tables", tables), ("python workers", arrow), ("recursive SQL", recursion)):
        try:
            probe()
            found[name] = {"status": "ok", "reason": None}
        except Exception as e:  # a probe may fail in any way; what it says is the answer
            found[name] = {"status": "unavailable", "reason": str(e).split("\n")[0][:200]}
    return found
