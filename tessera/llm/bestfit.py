"""Best-fit decreasing packing of tokenised documents, one plan for the whole table."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import keep

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: The split of the tokenizers file that words are cut by (a fixed value); what it leaves out is white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for a lower-cased run of printable ASCII and Latin-1 letters, all of which the normaliser leaves as they are but for case.
SIMPLE, CUT = re.compile("[!-~À-ÿ]+"), re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
END = b"\xff"


class WordEncoder(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of a tokenizers JSON file whose tokens never cross white space.

    A text is cut at ASCII white space; what lies between is encoded once and remembered (this is the dictionary of it). Files of other kinds (``plain``), and texts
    that hold an added token, are encoded whole. A run of simple characters is cut into words here and each is merged by the faster
    library: the byte 255, which no text holds, stands for the end of a word, and as its merges with single bytes have the lowest ranks
    they come first. Both libraries give the same ids if every token of the vocabulary, merged from its bytes, is itself; tests check that.
    """

    def __init__(self, path: str, longest: int = 64, most: int = 1 << 19):
        from tokenizers import Tokenizer

        self.whole, self.longest, self.most = Tokenizer.from_file(path), longest, most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added, model = (spec.get("pre_tokenizer") or {}).get("pretokenizers", []), spec.get("added_tokens", []), spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": SPLIT} and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"]
        self.plain = cuts and kinds == ["NFC", "Replace", "Lowercase"] and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(t.get(how) for t in added for how in ("lstrip", "rstrip", "single_word", "normalized"))
        if self.plain:
            import tiktoken

            self.added = [t["content"] for t in added]
            self.run = Tokenizer.from_str(json.dumps({**spec, "added_tokens": []}))
            self.merged = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks_of(model["vocab"], set(self.added)), special_tokens={})._encode_single_piece

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "surrogatepass")
        if len(text) > self.longest:
            return np.array(self.run.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if SIMPLE.fullmatch(text):
            ids = [i for word in CUT.findall(text.lower()) for i in self.merged(word.encode() + END)]
        else:
            ids = self.run.encode(text, add_special_tokens=False).ids
        if len(self) >= self.most:
            self.clear()
        self[run] = data = struct.pack(f"<{len(ids)}I", *ids)
        return data

    def __call__(self, text: str) -> bytes:
        if not self.plain or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


def ranks_of(vocab: dict[str, int], added: set[str]) -> dict[bytes, int]:
    """The vocabulary with bytes for the characters that show them and ``END`` for the end of a word."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out = {}
    for word, i in vocab.items():
        if word not in added:
            body, end = (word[:-4], END) if word.endswith("</w>") else (word, b"")
            out[bytes(byte_of[c] for c in body) + end] = i
    return out


class Rooms:
    """A segment tree over remaining capacities: how many groups of open bins have each room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest room of an open bin that is at least ``need``, in steps logarithmic in the capacity."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing for ``counts`` pieces of each length, and the number of bins it takes.

    Answers rows (length, first, per_bin, bin, offset): the pieces of that length from the ``first`` on go ``per_bin`` to a bin, from
    ``bin`` and ``offset`` on, until the next row of that length. Bins of like contents are one group, so the work and the rows depend
    on ``capacity`` alone: a length splits at most two groups, and a group takes a length once.
    """
    rooms, groups, plan, bins = Rooms(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            groups.setdefault(room, []).append((first, n))
            rooms.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, at = counts[length], 0
        while left:
            room = rooms.tightest(length)
            if room is None:  # bins opened one by one would each be filled before the next is opened
                n = -(-left // (capacity // length))
                put(capacity, bins, n)
                bins += n
                continue
            first, n = groups[room].pop()
            rooms.add(room, -1)
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, at, each, first, capacity - room))
                put(room - each * length, first, full)
                at, left = at + full * each, left - full * each
            if left and full < n:  # fewer than a bin takes
                plan.append((length, at, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
                left = 0
            else:
                put(room, first + full, n - full)
    return plan, bins


def pieces_of(docs: DataFrame, tokenizer: str, *, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The pieces of every document (its ids, then ``end_id``), with the task that made it and its number among that task's pieces of the same length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, part, made = WordEncoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = (encode(text) if text else b"") + end
                for piece, at in enumerate(range(0, len(data) // 4, capacity)):
                    own = data[4 * at : 4 * (at + capacity)]
                    n = len(own) // 4
                    nth = made[n] = made.get(n, -1) + 1
                    rows.append((None if pd.isna(doc_id) else int(doc_id), piece, at, n, zlib.crc32(own), part, nth))
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def _frame(rows: Iterable[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def pack_best_fit(docs: DataFrame, tokenizer: str, *, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack every document (its ids, then ``end_id``) into few sequences of at most ``capacity`` ids: best-fit decreasing over the whole table.

    Only documents longer than that are cut, into pieces of ``capacity``. Best-fit decreasing asks for nothing but how many pieces
    there are of each length, and there are at most ``capacity`` lengths: these counts reach the driver, where the plan is made
    (``best_fit``); its size depends on ``capacity`` alone, so it is broadcast. The n-th piece of a length finds its place in the plan: its number is
    the number in its own task plus what earlier tasks made of that length. So no piece meets another in a task, whatever the partitions, the result is that of
    one machine with all pieces, and a retried task places its pieces as before. ``tokenizer`` is a file that each executor can open.

    A null or empty text is the end id alone; null ids and repeated rows are packed like any others; extra columns are ignored; a
    very long text is many full sequences; ties go by task and place, so the same splits give the same rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = keep(pieces_of(docs, tokenizer, end_id=end_id, capacity=capacity), "pieces")
    made = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit(counts, capacity)
    length, first, per_bin, bin_, offset = (np.array(x, np.int64) for x in (zip(*sorted(plan)) if plan else [[]] * 5))
    table = spark.sparkContext.broadcast(((length << 48) + first, first, per_bin, bin_, offset))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, first, per_bin, bin_, offset = table.value
        for batch in batches:
            n, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, (n << 48) + rank, side="right") - 1
            within = rank - first[at]
            out = batch[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(sequence_id=bin_[at] + within // per_bin[at], offset=offset[at] + within % per_bin[at] * n)

    before = made.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, PACKED)
