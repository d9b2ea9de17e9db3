"""Lines and spans of files: the innermost span around a line, and spans that overlap, without pairing all with all."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Lines of a file that are swept together; a longer file is many groups.
BLOCK_LINES = 4096


def _blocks(first: Column, last: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(first / size), F.floor(F.greatest(first, last) / size)))


def _block(line: Column) -> Column:
    """The block of a line, by the lines of a block of its level."""
    return F.floor((line - F.pmod(line, F.col("lines"))) / F.col("lines"))


def stab(points: DataFrame, symbol: DataFrame, reach: int = 0, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_path, line, handler for distinct points: the shortest span around the line, then the smallest id; else the first that starts at most ``reach`` lines below.

    One sorted stream for each block of lines of a file: spans by their start, then the points at a line. Open spans wait in a heap by length; one that
    has ended is dropped when it comes to the top, so spans need not nest. Points without one wait for the next start. Each
    event is handled once, and a task holds the spans that are open and the points that wait within ``reach``. Spans are swept by levels of length, four times longer from level to
    level, in blocks as long as the spans, so a span is there for two or three blocks however long it is, and a point once for each level
    that occurs. A file that holds most of the rows is many groups.
    """
    s = symbol.select("file_path", F.col("id").alias("sid"), F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND sid IS NOT NULL")
    size = block_lines
    level, sizes = F.lit(0), [size]
    while size < 1 << 60:
        level, size = level + (F.col("b") - F.col("a") > size).cast("int"), size * 4
        sizes.append(size)
    s = s.withColumn("level", level)
    levels = sorted(r.level for r in s.select("level").distinct().collect()) or [0]
    lines_of = F.element_at(F.array(*[F.lit(n).cast("long") for n in sizes]), F.col("level") + 1)
    held = s.withColumn("lines", lines_of)
    spans = held.select("file_path", "level", F.explode(F.sequence(_block(F.col("a") - reach), _block(F.greatest("a", "b")))).alias("block"), F.col("a").alias("at"), F.lit(0).alias("kind"), "sid", "b")
    file_type, id_type = points.schema["file_path"].dataType, symbol.schema["id"].dataType
    none = F.lit("" if isinstance(id_type, StringType) else 0).cast(id_type)
    each = points.select("file_path", F.col("line").cast("long").alias("line"), F.explode(F.array(*[F.lit(n) for n in levels])).alias("level")).withColumn("lines", lines_of)
    spots = each.select("file_path", "level", _block(F.col("line")).alias("block"), F.col("line").alias("at"), F.lit(1).alias("kind"), none.alias("sid"), F.lit(0).cast("long").alias("b"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, open_, waiting = None, [], []
        for batch in batches:
            out = []
            for *key, at, kind, sid, b in zip(*(batch[c].tolist() for c in ("file_path", "level", "block", "at", "kind", "sid", "b"))):
                if key != group:
                    group, open_, waiting = key, [], []
                if waiting and waiting[0][1] < at - reach:
                    waiting = [w for w in waiting if w[1] >= at - reach]
                if kind == 0:
                    out += [(*w, 1, at, sid) for w in waiting if w[1] < at]
                    waiting = [w for w in waiting if w[1] >= at]
                    if b >= at:
                        heapq.heappush(open_, (b - at, sid, b))
                else:
                    while open_ and open_[0][2] < at:
                        heapq.heappop(open_)
                    if open_:
                        out.append((key[0], at, 0, *open_[0][:2]))
                    else:
                        waiting.append((key[0], at))
            yield pd.DataFrame(out, columns=["file_path", "line", "below", "far", "handler"])

    events = spans.unionByName(spots).repartition("file_path", "level", "block").sortWithinPartitions("file_path", "level", "block", "at", "kind", "sid")
    found = events.mapInPandas(sweep, f"file_path {file_type.simpleString()}, line long, below int, far long, handler {id_type.simpleString()}")
    if len(levels) > 1:
        found = found.groupBy("file_path", "line").agg(F.min(F.struct("below", "far", "handler")).alias("best")).select("file_path", "line", "best.handler")
    return found.select("file_path", F.col("line").cast(points.schema["line"].dataType).alias("line"), "handler")


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[Column, Column], b_span: tuple[Column, Column], key: str, block_lines: int = 256) -> DataFrame:
    """Rows of ``a`` and ``b`` (no other column in common) of one ``key`` whose spans overlap: joined by blocks of lines, each pair at the first block they share."""
    left = a.withColumn("a_first", a_span[0].cast("long")).withColumn("a_last", a_span[1].cast("long")).where("a_first <= a_last")
    right = b.withColumn("b_first", b_span[0].cast("long")).withColumn("b_last", b_span[1].cast("long")).where("b_first <= b_last")
    left = left.withColumn("block", _blocks(F.col("a_first"), F.col("a_last"), block_lines))
    right = right.withColumn("block", _blocks(F.col("b_first"), F.col("b_last"), block_lines))
    met = left.join(right, [key, "block"]).where("a_first <= b_last AND b_first <= a_last")
    return met.where(F.col("block") == F.floor(F.greatest("a_first", "b_first") / block_lines)).drop("block", "a_first", "a_last", "b_first", "b_last")
