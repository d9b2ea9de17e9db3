"""Hierarchical multi-length packing of tokenised documents into training sequences."""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Encoder:
    """Token ids of the byte-level BPE in a tokenizers JSON file.

    Where the file is a plain byte-level BPE with the usual split, its vocabulary is given to the
    faster BPE library, whose ids are the same (tests compare them); any other file is run as it is.
    Added tokens of the file are found in a text as the file has it: each is one id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        plain = not any(t.get(how) for t in added for how in ("lstrip", "rstrip", "single_word"))
        if plain and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"):
            import tiktoken

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in shown]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
            special = {t["content"]: t["id"] for t in added}
            ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
            split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # it gives up on about a million characters of white space on end
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class Packer:
    """Packs one partition's stream of documents; holds about ``window`` tokens at a time.

    Whole windows of a long document are sequences at once. The tail goes to the tier of the smallest
    context that holds it. Every ``window`` tokens the tiers are packed from the longest down: each tail
    of a tier opens a sequence, the gap takes the largest tails of shorter tiers that fit, and gaps that
    remain are closed by cutting up the emptiest sequences of the shortest tier. What stays unfilled waits
    for the next window; at the end it is cut into powers of two, so nothing is padded.
    """

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, window: int = 1 << 20, step: int = 16):
        self.base, self.tiers, self.window, self.step = base, tiers, window, step
        self.tails: list[tuple[int, int]] = []  # (length, index into parts), ascending
        self.parts: dict[int, tuple] = {}
        self.held = self.sequences = self.groups = self.made = 0
        self.ready: list[tuple[int, list]] = []  # (tier, pieces)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, n = self.tiers[-1], len(ids)
        for at in range(0, n - n % top, top):
            self.ready.append((top, [(doc_id, at, ids[at : at + top], n)]))
            self.held += top
        if n % top:
            self._tail((doc_id, n - n % top, ids[n - n % top :], n))

    def _tail(self, part: tuple) -> None:
        self.parts[self.made] = part
        insort(self.tails, (len(part[2]), self.made))
        self.made += 1
        self.held += len(part[2])

    def full(self) -> bool:
        return self.held >= self.window

    def _take(self, most: int) -> tuple | None:
        """The longest waiting tail of at most ``most`` tokens."""
        i = bisect_right(self.tails, (most, self.made))
        return self.parts.pop(self.tails.pop(i - 1)[1]) if i else None

    def flush(self, last: bool = False) -> pd.DataFrame:
        open_bins: list[tuple[int, int, list]] = []  # (tier, filled, pieces)
        while self.tails:
            part = self._take(self.tiers[-1])
            filled, pieces = len(part[2]), [part]
            tier = next(t for t in self.tiers if t >= filled)
            while filled < tier and (more := self._take(tier - filled)):
                pieces.append(more)
                filled += len(more[2])
            if filled == tier:
                self.ready.append((tier, pieces))
            else:
                open_bins.append((tier, filled, pieces))
        # Gaps: the fullest are closed first, with what the emptiest of the shortest tier hold.
        open_bins.sort(key=lambda b: (-b[0], b[0] - b[1]))
        spare: list[tuple] = []
        i = 0
        while i < len(open_bins):
            tier, filled, pieces = open_bins[i]
            while filled < tier:
                if not spare:
                    if len(open_bins) - 1 <= i:
                        break
                    spare = open_bins.pop()[2]
                doc_id, at, ids, n = spare.pop()
                cut = min(len(ids), tier - filled)
                pieces.append((doc_id, at, ids[:cut], n))
                filled += cut
                if cut < len(ids):
                    spare.append((doc_id, at + cut, ids[cut:], n))
            if filled < tier:
                break
            self.ready.append((tier, pieces))
            i += 1
        left = spare + (open_bins[i][2] if i < len(open_bins) else [])
        self.held = 0
        if last:
            self._powers(left)
        else:
            for part in left:
                self._tail(part)
        return self._emit()

    def _powers(self, left: list[tuple]) -> None:
        total = sum(len(p[2]) for p in left)
        while total:
            want = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            total -= want
            pieces, need = [], want
            while need:
                doc_id, at, ids, n = left.pop()
                cut = min(len(ids), need)
                pieces.append((doc_id, at, ids[:cut], n))
                need -= cut
                if cut < len(ids):
                    left.append((doc_id, at + cut, ids[cut:], n))
            self.ready.append((want, pieces))

    def _emit(self) -> pd.DataFrame:
        """Number the ready sequences and deal them to step groups of like attention cost, dearest first."""
        n = max(1, -(-len(self.ready) // self.step))
        load = [(0, 0, g) for g in range(n)]
        cost = [sum(len(p[2]) ** 2 for p in pieces) for _, pieces in self.ready]
        group = [0] * len(self.ready)
        for k in sorted(range(len(self.ready)), key=lambda k: -cost[k]):
            c, m, g = heapq.heappop(load)
            group[k] = g
            if m + 1 < self.step:
                heapq.heappush(load, (c + cost[k], m + 1, g))
        rows = []
        for (tier, pieces), g in zip(self.ready, group):
            offset = 0
            for doc_id, at, ids, total in pieces:
                rows.append((doc_id, at, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")), total, self.base + self.sequences, offset, tier, self.base + self.groups + g))
                offset += len(ids)
            self.sequences += 1
        self.groups += n
        self.ready = []
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, tiers: tuple[int, ...] = TIERS, window: int = 1 << 20) -> DataFrame:
    """Pack every document (its ids, then ``end_id``) into sequences of at most the largest tier.

    One pass, no shuffle: each input partition is packed by itself in windows of about ``window`` tokens,
    so memory is bounded by that and the longest single document. Ids are
    deterministic for given input splits, so a retried task gives the same rows. ``tokenizer`` is a
    tokenizers JSON file that each executor can open.

    A null or empty text is the end id alone; null ids and repeated rows are packed like any others; extra
    columns are ignored; an empty table gives no rows. ``tiers`` are ascending powers of two.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32)
        packer = Packer(TaskContext.get().partitionId() << 34, tiers, window)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) if text else end[:0]
                packer.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate([ids, end]))
                if packer.full():
                    yield packer.flush()
        yield packer.flush(last=True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SCHEMA)
