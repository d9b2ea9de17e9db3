"""Personal data and secrets against plain scans written from the definitions."""

import base64
import gzip
import hashlib
import os
import random
import re
import subprocess
import sys
import urllib.parse
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.pii import KINDS, expectation_maximisation, find_personal_data
from tessera.llm.secrets import find_secrets, redact_text, scan


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_pii(text):
    found = [(m.start(), i, m.end()) for i, (p, ok) in enumerate(PII.values()) for m in re.finditer(p, text or "") if ok(m.group())]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


TEXTS = [
    None,
    "",
    "a@b.c_x@d.e and a@b.c.d@e.f",
    "mail joe (at) example (dot) com now",
    "é😀 x.y+z@mail-1.example.com, 1.2.3.4.5.6.7.8 and 300.1.1.1 0001.2.3.255 😀 9.9.9.9",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 79927398713 " + "0" * 16,
    "+1 (988) 555-2485 x +49 (0)30 123456-78 +12 +1" + " " * 50 + "2",
    "call 555-867-5309 or 00 44 555",
    "1" * 30000 + " " + "a" * 50000 + "@" + "b" * 10 + " " + "1 2 " * 9000 + "+1" + "." * 20000,
    "ip 10.0.0.1 ip 10.0.0.1",
]


def test_personal_data_base_spans(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string, cand int")
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    for i, text in enumerate(TEXTS):
        want = plain_pii(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), text and text[:60]
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(got[i].spans.split(","))
    assert find_personal_data(df.limit(0)).count() == 0


def test_personal_data_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.base_sha256 for r in find_personal_data(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in plain_pii(r.text)).encode()).hexdigest()


def test_em_trusts_agreeing_labelers():
    patterns = [(0, (1, 1, 1, 1), 50.0), (0, (0, -1, -1, -1), 50.0), (0, (1, 1, 0, 0), 5.0)]
    post, reliability = expectation_maximisation(patterns)
    assert post[0] > 0.95 and post[1] < 0.05 and post[2] > 0.5
    assert all(0.5 < r < 1 for r in reliability.values())


SECRETS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain_secrets(text):
    found = [(m.start(), i, m.end()) for i, (p, ok) in enumerate(SECRETS.values()) for m in p.finditer(text or "") if ok(m)]
    return [(list(SECRETS)[k], s, e) for s, k, e in sorted(found)]


INNER = "api_" + "key=" + "Zz9" * 5
WRAPPED = [
    base64.b64encode(INNER.encode()).decode(),
    base64.b64encode(base64.b64encode(INNER.encode())).decode(),
    base64.b64encode(gzip.compress(INNER.encode())).decode(),
    base64.urlsafe_b64encode(zlib.compress(base64.b64encode(INNER.encode()))).decode(),
    urllib.parse.quote(INNER, safe=""),
    urllib.parse.quote(base64.b64encode(INNER.encode()).decode(), safe=""),
    "".join(f"\\u{ord(c):04x}" for c in INNER),
    urllib.parse.quote("".join(f"\\u{ord(c):04x}" for c in base64.b64encode(INNER.encode()).decode()), safe=""),
]


@pytest.mark.parametrize("wrapped", WRAPPED)
def test_wrapped_secrets_are_found_in_place(wrapped):
    text = f"é😀 before {wrapped} after"
    base, spans = scan(text)
    assert not [s for s in base if s[0] == 0]
    at = text.index(wrapped)
    assert any(k == 0 and at <= a < b <= at + len(wrapped) for k, a, b in spans)
    assert not any(INNER in layer for layer in (redact_text(text),))
    assert scan(redact_text(text))[1] == []


@pytest.mark.parametrize("wrapped", WRAPPED)
def test_repeated_wrapped_secrets_are_found_in_every_place(wrapped):
    outer = base64.b64encode(f"first {wrapped} and then {wrapped} last".encode()).decode()
    text = f"a {wrapped} z {wrapped} y {outer} x {outer}"
    spans = [(a, b) for k, a, b in scan(text)[1] if k == 0]
    at = -1
    for part in (wrapped, wrapped, outer, outer):
        at = text.index(part, at + 1)
        assert sum(at <= a < b <= at + len(part) for a, b in spans) >= (2 if part is outer else 1)
    assert scan(redact_text(text))[1] == []


BLOBS = [w for w in WRAPPED if re.fullmatch(r"[A-Za-z0-9+/_=-]+", w)]
LONG = "".join(f"line {i} of {i * i} \U0001f600\n" for i in range(40)) + INNER + "".join(f" {i ** 3}" for i in range(40))


@pytest.mark.parametrize("blob", BLOBS)
@pytest.mark.parametrize("before", ["https://h.example/cb/", "key-", "user_", "k/", "id12345-", "a/b/c_d-e/", "xy"])
@pytest.mark.parametrize("after", ["", "/edit", "_v2"])
def test_wrapped_secrets_are_found_beside_other_words(blob, before, after):
    text = f"see {before}{blob.rstrip('=')}{after} there"
    at = text.index(blob.rstrip("="))
    assert any(k == 0 and at - 1 <= a < b <= at + len(blob) + len(after) for k, a, b in scan(text)[1])
    assert scan(redact_text(text))[1] == []


@pytest.mark.parametrize("data", [LONG.encode(), gzip.compress(LONG.encode()), zlib.compress(base64.b64encode(LONG.encode()))])
@pytest.mark.parametrize("width,newline", [(76, "\n"), (64, "\r\n"), (76, "\n    ")])
def test_secrets_in_wrapped_lines_are_found(data, width, newline):
    blob = base64.b64encode(data).decode()
    lines = newline.join(blob[i : i + width] for i in range(0, len(blob), width))
    for before in ("first\n", "body: ", "file/"):
        text = f"{before}{lines}\nafter"
        found = [(a, b) for k, a, b in scan(text)[1] if k == 0]
        assert found and all(len(before) - 1 <= a < b <= len(before) + len(lines) for a, b in found)
        assert scan(redact_text(text))[1] == []


def test_secret_layers_end():
    """An encoding that decodes to what was seen is not entered again; plain text has no layers."""
    assert scan("%2525252541KIA") == ([], [])
    assert scan("plain words only") == ([], [])


def test_secrets_base_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "token: ab token=abcdef TOKEN'='xyz12345 AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " " + "a" * 23 + " " + "f" * 24), (-4, "tokenKEY" * 40000), (None, "x")], "doc_id long, text string")
    every = docs.unionByName(odd)
    text = {r.doc_id: r.text for r in every.collect()}
    got = find_secrets(every.withColumn("f", every.doc_id)).collect()
    assert len(got) == len(text)
    for r in got:
        want = plain_secrets(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[0] == k for w in want) for k in SECRETS]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(filter(None, r.spans.split(","))) or not want


# --- places of escapes, against a decoder that works character by character ------------------------


def plain_step(chars):
    """One round of decoding of (character, start, end) triples, or None if nothing decodes."""
    text, out, i, changed = "".join(c for c, _, _ in chars), [], 0, False
    while i < len(chars):
        run, j = [], i
        while m := re.compile(r"%([0-9A-Fa-f]{2})").match(text, j):
            run.append((int(m[1], 16), chars[j][1], chars[j + 2][2]))
            j += 3
        if run:
            k = 0
            while k < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        c = bytes(b for b, _, _ in run[k : k + n]).decode()
                        break
                    except UnicodeDecodeError:
                        c = None
                if c is None or k + n > len(run):
                    c, n = chr(run[k][0]), 1
                out.append((c, run[k][1], run[k + n - 1][2]))
                k += n
            i, changed = j, True
        elif (m := re.compile(r"\\u([0-9A-Fa-f]{4})").match(text, i)) and not 0xD800 <= int(m[1], 16) < 0xE000:
            out.append((chr(int(m[1], 16)), chars[i][1], chars[i + 5][2]))
            i, changed = i + 6, True
        else:
            out.append(chars[i])
            i += 1
    return out if changed else None


def plain_cover(text):
    """The places of the document that a finding of any layer covers."""
    layer, covered = [(c, i, i + 1) for i, c in enumerate(text)], set()
    while layer is not None:
        for _, a, b in plain_secrets("".join(c for c, _, _ in layer)):
            covered |= {p for _, s, e in layer[a:b] for p in range(s, e)}
        layer = plain_step(layer)
    return covered


def percent(text, every=True):
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if every or c in "%\\=" or ord(c) > 127 else c for c in text)


def unicode_escapes(text):
    return "".join(f"\\u{ord(c):04x}" if ord(c) < 0x10000 else c for c in text)


LEAKS = [percent("€" * 8 + "token=hunter22") + " " * 40, percent("token=hunter22€€") + "x", percent("😀é") + percent("secret: abcdef99"), "%E9t%E9" + percent("token=abcdefg") + "%FF%C3 z"]


@pytest.mark.parametrize("text", LEAKS)
def test_characters_of_many_bytes_move_no_span(text):
    assert {p for _, a, b in scan(text)[1] for p in range(a, b)} == plain_cover(text)
    left = redact_text(text)
    while (more := urllib.parse.unquote(left, errors="replace")) != left:
        left = more
    assert not re.search("unter|bcdef", left)


def test_generated_nestings_equal_the_plain_decoder():
    rng = random.Random(12)
    for _ in range(1000):
        inner = rng.choice(["token=", "api_key: ", 'passwd="', "AKIA", ""]) + "".join(rng.choice("abcdef0123456789") for _ in range(rng.choice([7, 20, 30])))
        text = rng.choice(["", "é ", "€", "a😀 "]) + (inner.upper() if inner.startswith("AKIA") else inner) + rng.choice(["", " ", "€", "ß x"])
        for _ in range(rng.randrange(4)):
            text = rng.choice([percent, lambda t: percent(t, every=False), unicode_escapes])(text)
            text = rng.choice(["", "see ", "Ω "]) + text + rng.choice(["", " end", "!"])
        assert {p for _, a, b in scan(text)[1] for p in range(a, b)} == plain_cover(text), text


@pytest.mark.parametrize("wrap", [lambda b: b, gzip.compress, lambda b: gzip.compress(gzip.compress(b)), lambda b: gzip.compress(b[:20]) + gzip.compress(b[20:]), lambda b: b"\x00\xff\xfe" + zlib.compress(b) + b"\xff"])
@pytest.mark.parametrize("data", [INNER.encode("utf-16"), INNER.encode("utf-16-be"), b"\x00\xff\x81" * 9 + INNER.encode() + b"\xfe\x00", INNER.encode() * 3])
def test_binary_layers_are_read(wrap, data):
    blob = base64.b64encode(wrap(data)).decode()
    assert any(k == 0 and 4 <= a < b <= 4 + len(blob) for k, a, b in scan(f"see {blob} end")[1])
    assert scan(redact_text(f"see {blob} end"))[1] == []


MEMORY = """
import base64, sys, time, zlib
from tessera.llm.secrets import scan
line, pack = b"2026-01-01 an ordinary line of a log, with words.\\n" * 20, zlib.compressobj()
data = b"".join(pack.compress(line) for _ in range((1 << 26) // len(line))) + pack.compress(b"password=hunter2222\\n") + pack.compress(line) + pack.flush()
blob = base64.b64encode(data).decode()
assert scan("x " + blob + " y")[1] == [(0, 2, 2 + len(blob))] or scan("x " + blob + " y")[1][0][:2] == (0, 2)
began = time.time()
for text in ("%" + "25" * 100_000, "%" + "5Cu0025" * 30_000 + "41", "\\\\" + "u005c" * 40_000 + "u0041", "\\\\u{5c}" + "x5cu00255C" * 20_000):
    scan(text)
assert time.time() - began < 20
print(next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("VmHWM")) // 1024)
"""


def test_deep_and_large_layers_are_bounded():
    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 300


def test_self_reproducing_streams_end():
    data = gzip.compress(INNER.encode())
    for _ in range(40):
        data = gzip.compress(data)
    assert [s[0] for s in scan("x " + base64.b64encode(data).decode())[1]] == [0]
    assert scan(base64.b64encode(b"\x1f\x8b\x08" + b"\x00" * 40).decode())[1] == []


def test_secrets_of_odd_tables(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "word " * 200_000 + INNER + " word" * 200_000), (2, "token=abcdefg")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("f", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("base", F.lit(2))
    got = sorted(((r.doc_id or 0, r.n_assign, r.spans) for r in find_secrets(df).collect()))
    assert got == [(0, 0, ""), (1, 0, ""), (1, 0, ""), (2, 1, "assign:0:13"), (2, 1, f"assign:1000000:{1_000_000 + len(INNER)}")]
    assert find_secrets(df.limit(0)).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and find_secrets(df.limit(0)).count() == 0
