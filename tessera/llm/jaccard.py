"""N-gram Jaccard self-join: size-banded tiles, hashed bitmaps that bound the overlap, exact sorted-array intersection."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph.components import connected_components
from tessera.llm.common import slices
from tessera.session import discard, keep

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = np.random.default_rng(20_231).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWER = np.cumprod(np.full(256, 0xD1342543DE82EF95, dtype=np.uint64))
HEAVY_BITS = 20
GROUP_BYTES = 256 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = 4) -> np.ndarray:
    """The sorted 64-bit hashes of a whole text's distinct k-word shingles; of all its words if they are fewer."""
    if not text:
        return np.zeros(0, np.uint64)
    global _POWER
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    space = np.ones(len(b) + 2, np.int8)
    space[1:-1] = _SPACE[b]
    edge = np.flatnonzero(np.diff(space))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    if len(_POWER) < (longest := int(size.max())):
        _POWER = np.cumprod(np.full(longest, 0xD1342543DE82EF95, dtype=np.uint64))
    at = np.cumsum(size) - size
    letter = np.arange(int(size.sum())) - np.repeat(at, size)
    word = _mix(np.add.reduceat(_BYTE[b[letter + np.repeat(start, size)]] * _POWER[letter], at) + size.astype(np.uint64) * _GOLD)
    n = max(1, len(word) - k + 1)
    out = np.full(n, min(k, len(word)), np.uint64)
    for i in range(min(k, len(word))):
        out = _mix(out * _GOLD + word[i : i + n])
    return np.unique(out)


def bitmap(s: np.ndarray) -> bytes:
    """A signature of at least 2 bits per shingle; a shingle sets the bit of its low bits."""
    bits = max(128, 1 << (2 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def bitmap_of_size(n: int) -> bytes:
    """An empty signature as wide as that of a set of n shingles."""
    return bytes(max(128, 1 << (2 * n - 1).bit_length()) // 8)


def folded(bits: bytes, width: int) -> np.ndarray:
    """The signature of the same set at a smaller width."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width // 8), axis=0)


def is_link(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The intersection size of two sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The runs of equal keys of a sorted stream, each as columns; a run may span batches."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not len(batch):
            continue
        cols = {c: batch[c].to_numpy() for c in batch.columns}
        if held is not None:
            cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
        change = np.zeros(len(cols[key[0]]) - 1, bool)
        for c in key:
            change |= cols[c][1:] != cols[c][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1)]
        for x, y in zip(cuts, cuts[1:]):
            yield {c: v[x:y] for c, v in cols.items()}
        held = {c: v[cuts[-1] :] for c, v in cols.items()}
    if held is not None:
        yield held


def _frequent(docs: DataFrame, k: int, most: int) -> np.ndarray:
    """Counts per hash bucket of shingles that stand out as frequent: how rare a shingle is, for ordering only.

    Every text counts. Each task adds up its own in a table of fixed size and sends the buckets far above their mean;
    at most ``most`` come to the driver. A bucket that is missed costs time, never a link.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << HEAVY_BITS, np.int64)
        for batch in slices(batches):
            if len(batch):
                seen += np.bincount(np.concatenate([shingles(t, k) >> np.uint64(64 - HEAVY_BITS) for t in batch["text"]]).astype(np.int64), minlength=len(seen))
        mean = seen.mean()
        at = np.flatnonzero(seen >= mean + 6 * math.sqrt(mean) + 4)
        yield pd.DataFrame({"bucket": at, "n": seen[at]})

    top = docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "bucket").limit(most).toPandas()
    out = np.zeros(1 << HEAVY_BITS, np.int64)
    out[top["bucket"].to_numpy(np.int64)] = top["n"].to_numpy()
    return out


def _described(docs: DataFrame, k: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """Per row: set size, a 128-bit name of the set, its prefix, rarest shingles first, and its signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = []
            for doc_id, tie, text in zip(batch["doc_id"], batch["tie"], batch["text"]):
                s = shingles(text, k)
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                length = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                order = np.lexsort((s, heavy[(s >> np.uint64(64 - HEAVY_BITS)).astype(np.int64)]))[:length]
                rows.append((doc_id, tie, len(s), a, b, s[order].view(np.int64), bitmap(s) if len(s) else b""))
            out = pd.DataFrame(rows, columns=["doc_id", "tie", "n", "k1", "k2", "prefix", "bits"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.mapInPandas(run, "doc_id long, tie long, n int, k1 long, k2 long, prefix array<long>, bits binary")


def _may_link(a: int, b: int, apart: int, percent: int) -> bool:
    """Whether sizes and the number of differing signature bits leave a link possible: each differing bit is a shingle of one side only."""
    return is_link(a, b, min(a, b, (a + b - apart) // 2), percent)


def _may_link_row(bits: np.ndarray, n: np.ndarray, i: int, rest: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``rest`` that may link to row i."""
    apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
    both = np.minimum(np.minimum(n[rest], n[i]), (n[rest] + n[i] - apart) // 2)
    return rest[100 * both >= percent * (n[rest] + n[i] - both)]


def _forest(count: int, near) -> list[tuple[int, int]]:
    """Edges that connect what ``near(i, rest)`` connects: a search over rows that were not reached before."""
    left, out = np.arange(count), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if len(hit):
                out += [(i, j) for j in hit]
                queue += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return out


def _bands(percent: int) -> float:
    """The logarithm of the ratio that sizes of one band stay within; sets that link are in one band or in neighbouring ones."""
    return math.log(100 / percent) * (1 + 1e-9)


def _joined(count: int, pairs: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A forest of the graph of ``pairs`` over ``count`` nodes, and the root of each node."""
    root, out = list(range(count)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out, np.array([find(i) for i in range(count)], np.int64)


def _signatures(items: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of sets of at least 8 bits a member of the largest."""
    wide = 1 << max(7, int(8 * max(map(len, items)) - 1).bit_length())
    bits = np.zeros((len(items), wide // 64), np.uint64)
    for i, x in enumerate(items):
        at = (x & np.uint64(wide - 1)).astype(np.int64)
        np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return bits


def _weak_edges(tiles: DataFrame, percent: int) -> DataFrame:
    """Per tile and band, a forest over the pairs that sizes and bitmaps let link: never more edges than rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        for g in _groups(batches, ["group", "band"]):
            m = len(g["vid"])
            if m < 2:
                continue
            width = min(map(len, g["bits"]))
            if m == 2:
                a, b = (int.from_bytes(folded(x, width).tobytes(), "little") for x in g["bits"])
                edges = [(0, 1)] if _may_link(int(g["n"][0]), int(g["n"][1]), (a ^ b).bit_count(), percent) else []
            else:
                bits, n = np.stack([folded(x, width) for x in g["bits"]]), g["n"].astype(np.int64)
                edges = _forest(m, lambda i, rest: _may_link_row(bits, n, i, rest, percent))
            out += [(g["vid"][i], g["vid"][j]) for i, j in edges]
            if len(out) > 50_000:
                yield pd.DataFrame(list(dict.fromkeys(out)), columns=["src", "dst"])
                out = []
        if out:
            yield pd.DataFrame(list(dict.fromkeys(out)), columns=["src", "dst"])

    return tiles.mapInPandas(run, "src long, dst long")


def _weak_leaders(rows: DataFrame, percent: int) -> DataFrame:
    """src, dst, group, band: edges of rows to leaders; rows that no leader is near have a null dst.

    Differing bits, at one width for the whole band, are a metric. A row is settled if a leader is as near as linked rows can be. What it can
    link to is then at most twice as far from that leader (with the band's largest size for the row's), so it is joined to the leader too:
    all that can link ends connected, though more may be.
    """
    share, ratio = (100 - percent) / (100 + percent), _bands(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["group", "band", "chunk"]):
            lead = g["kind"] == 0
            if not len(lead) or lead.all():
                continue
            band, most = int(g["band"][0]), math.exp(ratio * (g["band"][0] + 1)) + 1
            width = len(bitmap_of_size(max(1, int(math.exp(ratio * (band - 1)) - 1e-6))))
            bits, n = np.stack([folded(x, width) for x in g["bits"]]), g["n"].astype(np.float64)
            a, b = np.flatnonzero(lead), np.flatnonzero(~lead)
            apart = np.stack([np.bitwise_count(bits[b] ^ bits[i]).sum(axis=1) for i in a]) if len(a) else np.zeros((0, len(b)))
            settled = (apart <= share * (n[a][:, None] + n[b])).any(axis=0) if len(a) else np.zeros(len(b), bool)
            i, j = np.nonzero(apart <= share * (2 * most + n[a][:, None] + n[b]))
            edges, _ = _joined(len(lead), np.column_stack([a[i], b[j]]))
            vid = g["vid"]
            src, dst = [vid[x] for x, _ in edges] + vid[b[~settled]].tolist(), [vid[y] for _, y in edges] + [None] * int((~settled).sum())
            yield pd.DataFrame({"src": src, "dst": pd.array(dst, dtype="Int64"), "group": g["group"][0], "band": g["band"][0]})

    return rows.mapInPandas(run, "src long, dst long, group long, band int")


def _exact_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Per family and band, a forest over its true links: bitmaps wide enough to leave few candidates, then sorted arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["group", "band"]):
            if len(g["vid"]) < 2:
                continue
            items = [np.frombuffer(x, np.uint64) for x in g["items"]]
            n, bits = np.array([len(x) for x in items]), _signatures(items)

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                found = _may_link_row(bits, n, i, rest, percent)
                return np.array([j for j in found if is_link(n[i], n[j], overlap(items[i], items[j]), percent)], dtype=np.int64)

            edges = _forest(len(items), near)
            if edges:
                yield pd.DataFrame([(g["vid"][i], g["vid"][j]) for i, j in edges], columns=["src", "dst"])

    return blocks.mapInPandas(run, "src long, dst long")


def _exact_leaders(rows: DataFrame, percent: int) -> DataFrame:
    """src, dst, gap, what, group, band: true links of rows to leaders, and what they leave open.

    ``what`` is link (an edge of a forest), home (a row and its nearest linked leader, gap being their distance), guest (a row, and a leader
    of another component here, that lie at most twice the distance of a link apart) or none (a row that no leader links). Distances are
    Jaccard's, a metric: whatever links to a leader's row is the leader's guest, so only guests have to be compared with its rows.
    """
    wide = max(1, 2 * percent - 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["group", "band", "chunk"]):
            lead = g["kind"] == 0
            if not len(lead) or lead.all():
                continue
            items = [np.frombuffer(x, np.uint64) for x in g["items"]]
            n, bits, vid = np.array([len(x) for x in items]), _signatures(items), g["vid"]
            a, b = np.flatnonzero(lead), np.flatnonzero(~lead)
            linked, guests, home = [], [], {}
            for i in a:
                for j in _may_link_row(bits, n, i, b, wide):
                    both = len(items[i]) if vid[i] == vid[j] else overlap(items[i], items[j])
                    gap = 1 - both / (n[i] + n[j] - both)
                    if is_link(n[i], n[j], both, percent):
                        linked.append((i, j))
                        if j not in home or (gap, vid[i]) < home[j]:
                            home[j] = (gap, vid[i])
                    else:
                        guests.append((i, j, gap))
            edges, root = _joined(len(lead), np.array(linked, np.int64).reshape(-1, 2))
            out = [(vid[j], vid[i], 0.0, "link") for i, j in edges if vid[i] != vid[j]] + [(vid[j], r, gap, "home") for j, (gap, r) in home.items()]
            out += [(vid[j], vid[i], gap, "guest") for i, j, gap in guests if root[i] != root[j]] + [(vid[j], vid[j], 0.0, "none") for j in b if j not in home]
            yield pd.DataFrame(out, columns=["src", "dst", "gap", "what"]).assign(group=g["group"][0], band=g["band"][0])

    return rows.mapInPandas(run, "src long, dst long, gap double, what string, group long, band int")


def _exact_guests(rows: DataFrame, percent: int) -> DataFrame:
    """src, dst: a link of a guest to one of a leader's rows, where there is one. Rows nearer to the leader than the guest's distance less a link's can't."""
    reach = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["leader", "part", "lot"]):
            member = g["kind"] == 0
            if member.all() or not member.any():
                continue
            items = [np.frombuffer(x, np.uint64) for x in g["items"]]
            n, bits, gap = np.array([len(x) for x in items]), _signatures(items), g["gap"]
            out, inside = [], np.flatnonzero(member)
            for x in np.flatnonzero(~member):
                for y in _may_link_row(bits, n, x, inside[gap[inside] >= gap[x] - reach], percent):
                    if is_link(n[x], n[y], overlap(items[x], items[y]), percent):
                        out.append((g["vid"][x], g["vid"][y]))
                        break
            if out:
                yield pd.DataFrame(out, columns=["src", "dst"])

    return rows.mapInPandas(run, "src long, dst long")


def _once(rows: DataFrame, keys: list[str], *facts, where: str = "size > 1") -> DataFrame:
    """One group of ``keys`` (size and facts with it) of all those that hold the same rows, by a 128-bit name of the set of their vids; groups of one row fall away.

    Copies with small changes share most of their prefixes, and each shared shingle is a group of the same rows: one of them finds all there is.
    """
    mark = lambda salt: F.bit_xor(F.xxhash64("vid", F.lit(salt))).alias(f"set{salt}")
    named = rows.groupBy(*keys).agg(F.count("*").alias("size"), mark(1), mark(2), *facts).where(where)
    return named.groupBy("set1", "set2", "size", *keys[1:]).agg(F.min(keys[0]).alias(keys[0])).drop("set1", "set2")


def _banded(rows: DataFrame, group: str, percent: int) -> DataFrame:
    """Rows (group, vid, n) dealt to size bands: group, band, vid, size of the cell; of cells with the same rows one stays.

    Sizes that can link are in the same band or neighbouring ones: a row is at home in its band and a guest in the next.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / _bands(percent)).cast("int")
    placed = rows.select(F.col(group).alias("group"), "vid", F.explode(F.array(band, band + 1)).alias("band"), band.alias("own"))
    cells = _once(placed, ["group", "band"], F.max(F.col("own") == F.col("band")).alias("homes"), where="homes AND size > 1")
    return placed.drop("own").join(cells, ["group", "band"])


def _fits(chunk: int, percent: int):
    """How many rows of a band one task compares at once: ``chunk``, or fewer where sets are so large that they would fill GROUP_BYTES (16 bytes a shingle)."""
    most = F.exp(F.lit(_bands(percent)) * (F.col("band") + 1))
    return F.least(F.lit(chunk), F.greatest(F.lit(2), F.floor(F.lit(GROUP_BYTES / 16) / most))).cast("int")


def _beside_leaders(rows: DataFrame, what: DataFrame, wanted: int, chunk, turn: int) -> DataFrame:
    """Rows of populous cells dealt by hash to chunks, each chunk led by about ``wanted`` rows of its cell; joined to ``what`` (vid and more)."""
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    pick = F.xxhash64("vid", F.lit(turn))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("vid", F.lit(-1 - turn)), chunks).cast("int")).withColumn("kind", F.lit(1))
    lead = rows.where(F.pmod(pick, F.col("size")) < wanted).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("kind", F.lit(0))
    keys = ["group", "band", "chunk"]
    both = dealt.unionByName(lead).select(*keys, "kind", "vid").join(what, "vid")
    return both.repartition(*keys).sortWithinPartitions(*keys, "kind", "vid")


def _sized(rows: DataFrame) -> DataFrame:
    """group, band, vid with the size of each cell, of cells that have more than one row."""
    return rows.join(rows.groupBy("group", "band").agg(F.count("*").alias("size")).where("size > 1"), ["group", "band"])


def _together(cells: DataFrame, what: DataFrame) -> DataFrame:
    """The rows of each cell one after the other, with ``what`` is known of them."""
    return cells.select("group", "band", "vid").join(what, "vid").repartition("group", "band").sortWithinPartitions("group", "band", "vid")


def _rounds(cells: DataFrame, chunk, leaders: int, whole, led) -> list[DataFrame]:
    """Kept edges of all cells: ``whole`` compares the rows of a small cell; of a populous one ``led`` compares them with a few leaders, and
    gives edges and the rows (group, band, vid) that no leader settles, which go on. Each round has four times the leaders."""
    out, now, turn = [], cells, 0
    while True:
        out.append(keep(whole(now.where(F.col("size") <= chunk)), "edges"))
        large = now.where(F.col("size") > chunk)
        if large.isEmpty():
            return out
        edges, rest = led(large, leaders * 4**turn, turn)
        out += edges
        now, turn = keep(_sized(rest.distinct()), "cells"), turn + 1


def _guest_links(told: DataFrame, found: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links between guests that no link has yet connected with a leader, and the leader's rows; both dealt to pieces of about ``chunk``."""
    part = keep(connected_components(found), "parts")
    own, other = part.select(F.col("node").alias("src"), F.col("component").alias("c1")), part.select(F.col("node").alias("dst"), F.col("component").alias("c2"))
    open_ = told.where("what = 'guest'").join(own, "src", "left").join(other, "dst", "left").where("coalesce(c1, src) <> coalesce(c2, dst)")
    guest = keep(open_.select(F.col("dst").alias("leader"), F.col("src").alias("vid"), "gap").dropDuplicates(["leader", "vid"]), "guest")
    home = told.where("what = 'home'").select(F.col("dst").alias("leader"), F.col("src").alias("vid"), "gap").dropDuplicates(["leader", "vid"])
    pieces = lambda df, name: df.groupBy("leader").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))
    plan = pieces(guest, "lots").join(pieces(home, "parts"), "leader")
    deal = lambda df, own_name, own_n, far, far_n: df.join(plan, "leader").withColumn(own_name, F.pmod(F.xxhash64("vid"), F.col(own_n)).cast("int")).withColumn(far, F.explode(F.sequence(F.lit(0), F.col(far_n) - 1)))
    rows = deal(home, "part", "parts", "lot", "lots").withColumn("kind", F.lit(0)).unionByName(deal(guest, "lot", "lots", "part", "parts").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    keys = ["leader", "part", "lot"]
    beside = rows.select(*keys, "kind", "vid", "gap").join(sets, "vid").repartition(*keys).sortWithinPartitions(*keys, "kind", "vid")
    return _exact_guests(beside, percent)


def near_duplicates(docs: DataFrame, *, k: int = 4, percent: int = 85, chunk: int = 1024, leaders: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (and tie, a hash of the text, and group) of every row.

    Rows link when their shingle sets have a Jaccard similarity of at least ``percent`` / 100; the component is the
    smallest doc_id that links reach. No link is lost and no group's pairs are listed:

    1. Rows with the same set are one class.
    2. A class emits its prefix, the rarest of its shingles in an order that puts frequent ones last. Two sets that
       link share a shingle of both prefixes, so tiles of one shingle hold every link. Of tiles with the same classes one stays, so that
       signatures travel once for each different set of classes.
    3. A tile is split into size bands. In a cell of at most ``chunk`` rows, bitmap signatures bound overlaps from
       above, and a forest that connects what may link goes on, of fewer edges than rows. In a larger cell, rows are compared with
       some leaders only: differing bits are a metric, so rows near a leader need no comparison with each other.
    4. The components of these edges are families; all links lie within one. Families are split into bands again, and their sets
       intersected as sorted arrays where wider bitmaps still allow a link; a forest of the true links goes on. In large cells
       leaders serve again, now by the Jaccard distance; rows that lie near a leader but in another component are compared
       with the leader's rows. Work is rows times leaders where leaders settle rows, as they do among copies; in a populous cell
       of rows that share a rare shingle and little else each round asks four times the leaders, up to all rows of the cell, in chunks.
    5. The components of those are the result.

    Where a doc_id has several texts, two components can have the same smallest doc_id; ``group`` tells them apart, and is
    null where nothing links.

    Texts without words have an empty set and link with nothing, themselves included; rows with a null doc_id get a
    null component and link nothing; repeated rows are one class; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    heavy = _frequent(docs, k, most=1 << 16)
    described = keep(_described(docs, k, percent, heavy), "sets")

    named = described.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.first(F.struct("n", "prefix", "bits")).alias("first"))
    classes = keep(named.select(F.monotonically_increasing_id().alias("vid"), "k1", "k2", "least.*", "first.*"), "classes")
    rows = keep(described.select("doc_id", "tie", "n", "k1", "k2"), "rows")
    discard(described)

    posted = classes.select("vid", "n", F.explode("prefix").alias("tile"))
    shared = keep(posted.join(_once(posted, ["tile"]).select("tile"), "tile"), "shared")
    tiles = keep(_banded(shared, "tile", percent), "tiles")
    discard(shared)
    signed = classes.select("vid", "n", "bits")

    def weak_led(large: DataFrame, wanted: int, turn: int) -> tuple[list[DataFrame], DataFrame]:
        told = keep(_weak_leaders(_beside_leaders(large, signed, wanted, _fits(chunk, percent), turn), percent), "weak")
        return [told.where("dst IS NOT NULL").select("src", "dst")], told.where("dst IS NULL").select("group", "band", F.col("src").alias("vid"))

    weak = reduce(DataFrame.unionByName, _rounds(tiles, _fits(chunk, percent), leaders, lambda cells: _weak_edges(_together(cells, signed), percent), weak_led))
    discard(tiles)

    families = keep(connected_components(weak).select(F.col("node").alias("vid"), F.col("component").alias("family")), "families")
    wanted = classes.select("vid", "doc_id", "tie").join(families.select("vid"), "vid")
    texts = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"]).select("vid", "text")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            yield pd.DataFrame({"vid": batch["vid"], "items": [shingles(t, k).tobytes() for t in batch["text"]]})

    sets = keep(texts.mapInPandas(make, "vid long, items binary"), "items")

    def exact_led(large: DataFrame, wanted: int, turn: int) -> tuple[list[DataFrame], DataFrame]:
        told = keep(_exact_leaders(_beside_leaders(large, sets, wanted, _fits(chunk // 2, percent), turn), percent), "told")
        found = told.where("what = 'link'").select("src", "dst")
        return [found, keep(_guest_links(told, found, sets, percent, chunk // 2), "guests")], told.where("what = 'none'").select("group", "band", F.col("src").alias("vid"))

    cells = keep(_banded(families.join(classes.select("vid", "n"), "vid"), "family", percent), "cells")
    links = reduce(DataFrame.unionByName, _rounds(cells, _fits(chunk // 2, percent), leaders, lambda c: _exact_links(_together(c, sets), percent), exact_led))
    discard(cells, families, sets)

    final = connected_components(links)
    names = classes.select("vid", "k1", "k2", "doc_id").join(final.withColumnRenamed("node", "vid"), "vid")
    least = names.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("vid").alias("group"))
    by_set = names.join(least, "component").select("k1", "k2", "component_id", "group")
    alone = classes.select("k1", "k2", F.col("doc_id").alias("own"), F.col("vid").alias("own_group"))
    out = rows.select("doc_id", "tie", F.col("n").cast("long").alias("n_shingles"), "k1", "k2").join(alone, ["k1", "k2"], "left").join(by_set, ["k1", "k2"], "left")
    named_by = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "own"))
    group = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("group", "own_group"))
    return out.select("doc_id", "n_shingles", named_by.cast("long").alias("component_id"), "tie", group.alias("group"))
