"""Secret scanning with a worklist that unwraps nested encodings until nothing new appears."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# An escape can yield the sign that the next one begins with (%25 or \, by way of each other too). Such a chain is taken whole, so that
# its length costs one step: what the chain ends in is the character it yields.
_SLASH_AGAIN, _PERCENT_AGAIN = r"(?:u005[Cc]|x5[Cc]|u\{0*5[Cc]\})", r"(?:u0025|x25|u\{0*25\})"
_PERCENT = rf"%(?:25|5[Cc]{_SLASH_AGAIN}*{_PERCENT_AGAIN})*[0-9A-Fa-f]{{2}}"
_SLASH = rf"\\(?:{_SLASH_AGAIN}|{_PERCENT_AGAIN}(?:25)*5[Cc])*"
ESCAPE = re.compile(rf"(?P<bytes>(?:{_PERCENT})+|(?:{_SLASH}x[0-9A-Fa-f]{{2}})+)|(?P<units>(?:{_SLASH}u[0-9A-Fa-f]{{4}})+)|{_SLASH}u\{{(?P<point>[0-9A-Fa-f]{{1,6}})\}}")
ONE_ESCAPE = re.compile(rf"{_PERCENT}|{_SLASH}x[0-9A-Fa-f]{{2}}|{_SLASH}u[0-9A-Fa-f]{{4}}")
#: A run, or the runs of lines that follow each other; only the last of these may be short.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\r\n?|\n)[\x20\t]*[A-Za-z0-9+/_-]{16,}+)*+(?:(?:\r\n?|\n)[\x20\t]*[A-Za-z0-9+/_-]++)?={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
URL_SAFE = str.maketrans("-_", "+/")
#: How gzip and zlib streams (without a preset dictionary) begin.
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
#: Unpacked streams are read in pieces of this many bytes, so that none has to fit in memory.
PIECE = 1 << 22
#: What may belong to an encoded run; a piece ends before such a run where it can.
IN_RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\{}\r\n\t "
OVERLAP, LONGEST_CARRY = 4096, 1 << 24

Span = tuple[int, int, int]  # kind, start, end
Where = Callable[[int, int], tuple[int, int]]  # from a span of a layer to one of the document


def matches(text: str) -> list[Span]:
    """The base findings of one layer, by start then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in ASSIGN_KEYS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


class Layer:
    """A text and where its spans are in the document."""

    __slots__ = ("text", "where", "whole")

    def __init__(self, text: str, where: Where, whole: tuple[int, int] | None = None):
        self.text, self.where, self.whole = text, where, whole

    def key(self) -> tuple[bytes, tuple[int, int]]:
        """The text and its place: the same text elsewhere in the document is another layer."""
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.where(0, len(self.text))


def _inside(start: int, end: int) -> Layer:
    """An empty layer all of whose characters come from one span: compressed data have no places inside."""
    return Layer("", lambda a, b: (start, end), (start, end))


# --- escapes -----------------------------------------------------------------------------------


def _widths(text: str) -> np.ndarray | None:
    """UTF-8 bytes of each character, or None if all have one."""
    if text.isascii():
        return None
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def _from_bytes(raw: bytes) -> list[tuple[str, int]]:
    """Characters with the number of bytes they stand for: UTF-8 where it is valid, else one byte each."""
    text = raw.decode("utf-8", "surrogateescape")
    return [(chr(ord(c) - 0xDC00), 1) if "\udc80" <= c <= "\udcff" else (c, len(c.encode())) for c in text]


def _from_units(units: list[int]) -> list[tuple[str, int]]:
    """Characters with the number of UTF-16 units they stand for; half a pair is a replacement character."""
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            out.append((chr(0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00), 2))
            i += 2
        else:
            out.append(("�" if 0xD800 <= u < 0xE000 else chr(u), 1))
            i += 1
    return out


def _unescaped(layer: Layer) -> Layer | None:
    """The layer with every percent and Unicode escape decoded, or None if there is none.

    Character i of the result lies in a segment (at, start, step) and came from ``step`` characters from start + step * (i - at) on.
    """
    text, outer, parts, size, done = layer.text, layer.where, [], 0, 0
    at, start, step = array("q"), array("q"), array("q")

    def add(piece: str, origin: int, width: int) -> None:
        nonlocal size
        if not piece:
            return
        if not at or step[-1] != width or start[-1] + width * (size - at[-1]) != origin:
            at.append(size), start.append(origin), step.append(width)
        parts.append(piece)
        size += len(piece)

    for m in ESCAPE.finditer(text):
        if m["point"]:
            code = int(m["point"], 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                continue
            add(text[done : m.start()], done, 1)
            add(chr(code), m.start(), m.end() - m.start())
        else:
            add(text[done : m.start()], done, 1)
            edges, codes = [], []
            for one in ONE_ESCAPE.finditer(m.group()):
                edges.append(m.start() + one.start())
                codes.append(int(one.group()[-4 if m["units"] else -2 :], 16))
            edges.append(m.end())
            k = 0
            for c, n in _from_units(codes) if m["units"] else _from_bytes(bytes(codes)):
                add(c, edges[k], edges[k + n] - edges[k])
                k += n
        done = m.end()
    if not done:
        return None
    add(text[done:], done, 1)

    def where(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(at, a) - 1, bisect_right(at, max(a, b - 1)) - 1
        return outer(start[i] + step[i] * (a - at[i]), start[j] + step[j] * (b - at[j]))

    return Layer("".join(parts), where, layer.whole)


# --- compressed streams ------------------------------------------------------------------------


class _Inflated:
    """The content of the gzip or zlib stream, and of those that follow it at once, in ``blocks`` of bytes."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.read = blocks, 0

    def __iter__(self) -> Iterator[bytes]:
        rest = b""
        while True:
            stream = zlib.decompressobj(47)
            while not stream.eof:
                rest = rest or next(self.blocks, b"")
                if not rest:
                    return  # cut short: what there is counts
                try:
                    out = stream.decompress(rest, PIECE)
                except zlib.error:
                    return
                left = stream.unused_data if stream.eof else stream.unconsumed_tail
                self.read += len(rest) - len(left)
                rest = left
                if out:
                    yield out
            rest = rest or next(self.blocks, b"")
            if not PACKED.match(rest):
                return


def _blocks(raw: bytes, at: int = 0) -> Iterator[bytes]:
    return (raw[i : i + (1 << 16)] for i in range(at, len(raw), 1 << 16))


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes in larger pieces; a piece begins again with the encoded run that the one before it ended in."""
    held = b""
    for chunk in chunks:
        held += chunk
        if len(held) < PIECE:
            continue
        yield held
        run = len(held) - len(held[-LONGEST_CARRY:].rstrip(IN_RUN)) - max(0, len(held) - LONGEST_CARRY)
        # a run of more than LONGEST_CARRY bytes is cut: its parts are still read at all four alignments
        held = held[-(run if OVERLAP <= run < min(LONGEST_CARRY, len(held)) else OVERLAP) :]
    if held:
        yield held


def _opens(raw: bytes) -> bool:
    """Whether bytes that begin like a stream are one."""
    try:
        return bool(zlib.decompressobj(47).decompress(raw, 64))
    except zlib.error:
        return False


def _content(raw: bytes, at: int, seen: set, place: tuple[int, int]) -> Iterator[bytes]:
    """Pieces of the innermost content of the stream at ``at``; a stream met before at this place is not entered again."""
    chunks = iter(_Inflated(_blocks(raw, at)))
    while True:
        first = next(chunks, b"")
        chunks = chain([first], chunks)
        if not (PACKED.match(first) and _opens(first)):
            break
        mark = (hashlib.blake2b(first, digest_size=16).digest(), place)
        if mark in seen:
            return
        seen.add(mark)
        chunks = iter(_Inflated(chunks))
    yield from _pieces(chunks)


def _streams(raw: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of the streams in ``raw``."""
    at = 0
    while head := PACKED.search(raw, at):
        at = head.start() + 1
        if _opens(raw[head.start() : head.start() + (1 << 16)]):
            stream = _Inflated(_blocks(raw, head.start()))
            for _ in stream:
                pass
            yield head.start(), head.start() + stream.read
            at = max(at, head.start() + stream.read)


def _packed_layers(raw: bytes, at: int, where: tuple[int, int], seen: set) -> Iterator[Layer]:
    """What the stream at ``at`` holds, as text; binary content is read byte by byte, without its zeros too, and its own streams are opened."""
    for piece in _content(raw, at, seen, where):
        layer = _inside(*where)
        if (text := _readable(piece)) is not None:
            layer.text = text
            yield layer
            continue
        for reading in {piece, piece.replace(b"\0", b"")}:
            if _tells(text := reading.decode("latin-1")):
                layer = _inside(*where)
                layer.text = text
                yield layer
        mark = (hashlib.blake2b(piece, digest_size=16).digest(), where)
        if mark not in seen:
            seen.add(mark)
            for start, _ in _streams(piece):
                yield from _packed_layers(piece, start, where, seen)


# --- base64 ------------------------------------------------------------------------------------


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = len(raw) - len(raw.translate(None, bytes(b for b in range(32) if b not in b"\t\n\r")))
    return text if text and odd * 20 <= len(text) else None


def _base64_bytes(body: str) -> bytes:
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body.translate(URL_SAFE) + "=" * (-len(body) % 4))


def _base64_runs(text: str) -> Iterator[tuple[str, list[int], list[int], int]]:
    """The characters of each run, its lines (where each begins in the run and in the text), and where the run ends; lines that
    follow each other also as one run."""
    for m in BASE64.finditer(text):
        lines = [(m.start() + n.start(), n.group()) for n in LINE.finditer(m.group())]
        for i, (at, body) in enumerate(lines):
            if len(body) >= 16:
                yield body, [0], [at], m.end() if i == len(lines) - 1 else at + len(body)
        if len(lines) > 1:
            begin = [0]
            for _, body in lines[:-1]:
                begin.append(begin[-1] + len(body))
            yield "".join(body for _, body in lines), begin, [at for at, _ in lines], m.end()


def _tells(text: str) -> bool:
    """Whether a layer of this text has findings or further layers."""
    return bool(matches(text) or BASE64.search(text) or ESCAPE.search(text))


def _from_base64(layer: Layer, seen: set) -> Iterator[Layer]:
    """What the runs of a layer decode to.

    A run that isn't readable from its start may have a path, an id or other words before the encoded part or
    after it, so it is read at each of the four alignments, byte by byte, and streams are opened wherever one begins.
    """
    for body, begin, lines, end in _base64_runs(layer.text):

        def place(c: int) -> int:
            i = bisect_right(begin, c) - 1
            return lines[i] + c - begin[i]

        def span_of_bytes(p: int, q: int, shift: int) -> tuple[int, int]:
            return layer.where(place(shift + p * 4 // 3), place(min(len(body), shift - (-q * 4 // 3)) - 1) + 1)

        def child(text: str, shift: int, first: np.ndarray | None, stop: np.ndarray | None) -> Layer:
            """With the byte at which each character begins and ends, if these aren't its own number."""
            if layer.whole:
                return Layer(text, layer.where, layer.whole)
            return Layer(text, lambda a, b: span_of_bytes(a if first is None else int(first[a]), b if stop is None else int(stop[max(a, b - 1)]), shift))

        aligned = len(body) % 4 != 1
        raw = _base64_bytes(body)
        if aligned and (text := _readable(raw)) is not None:
            width = _widths(text)
            stop = None if width is None else np.cumsum(width)
            yield child(text, 0, None if stop is None else stop - width, stop)
            continue
        if aligned and PACKED.match(raw) and _opens(raw[: 1 << 16]):
            stream = _Inflated(_blocks(raw))
            for _ in stream:
                pass
            if stream.read == len(raw):
                yield from _packed_layers(raw, 0, layer.where(place(0), end), seen)
                continue
        for shift in range(4):
            raw = _base64_bytes(body[shift:])
            if _tells(text := raw.decode("latin-1")):
                yield child(text, shift, None, None)
            if 4 * raw.count(b"\0") > len(raw):
                kept = np.flatnonzero(np.frombuffer(raw, np.uint8))
                if _tells(text := raw.replace(b"\0", b"").decode("latin-1")):
                    yield child(text, shift, kept, kept + 1)
            for a, b in _streams(raw):
                yield from _packed_layers(raw, a, span_of_bytes(a, b, shift), seen)


# --- the worklist ------------------------------------------------------------------------------


def _children(layer: Layer, seen: set) -> Iterator[Layer]:
    yield from _from_base64(layer, seen)
    if ("%" in layer.text or "\\" in layer.text) and (child := _unescaped(layer)):
        yield child


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text: base ones plus those of every layer reached by decoding.

    Layers are worked off a list until none is new; a layer whose text was seen before from the same
    place of the document is not entered again, so self-reproducing encodings end. The list holds what is still to
    come of each layer, and of texts seen only hashes, so that a deep nesting needs no more memory than its largest parts.
    """
    base = matches(text)
    found, top = dict.fromkeys(base), Layer(text, lambda a, b: (a, b))
    seen: set = {top.key()}
    work = [_children(top, seen)]
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
            continue
        if child.whole and all((k, *child.whole) in found for k in range(len(KINDS))):
            continue  # one span, and it has every kind already
        if (key := child.key()) in seen:
            continue
        seen.add(key)
        for kind, start, end in matches(child.text):
            found[(kind, *child.where(start, end))] = None
        work.append(_children(child, seen))
    return base, sorted(found, key=lambda s: (s[1], s[0], s[2]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def findings(text: Column) -> Column:
    """A struct of the counts and digest of the base spans and the string of all spans of a text."""

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch:
                base, spans = scan(value) if value else ([], [])
                n = [sum(s[0] == k for s in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run(text.cast("string"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the findings of every whole text, one row per row, without a shuffle.

    Null and empty texts have no findings; repeated rows and null ids are scanned like others; extra
    columns are ignored; an empty table gives no rows. Very long texts and layers are read whole: a compressed layer in pieces
    that overlap, each of its findings having the span of the stream.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), findings(F.col("text")).alias("f")).select("doc_id", "f.*")


def redact_text(text: str) -> str:
    """The text with every finding replaced by [REMOVED kind]; overlapping spans become one."""
    out, at = [], 0
    merged: list[list[int]] = []
    for kind, start, end in scan(text)[1]:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[REMOVED {KINDS[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    """The text without its secrets; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(redact_text, na_action="ignore")

    return run(text.cast("string"))
