"""Collocations, hard negatives and best-fit packing against plain versions, and on odd tables."""

import bisect
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bestfit, collocations, hardneg
from tessera.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")

# --- best fit ----------------------------------------------------------------------------------


def plain_best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bins += room == capacity
        bisect.insort(rooms, room - n)
    return bins, rooms


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 50, 2048])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 5)])) for _ in range(rng.randint(0, 400))]
    counts = Counter(lengths)
    plan, bins = bestfit.best_fit(counts, capacity)
    plan.sort()
    used = [set() for _ in range(bins)]
    for i, (length, first, per_bin, bin_, offset) in enumerate(plan):
        end = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else counts[length]
        for k in range(end - first):
            places = set(range(offset + k % per_bin * length, offset + (k % per_bin + 1) * length))
            assert not places & used[bin_ + k // per_bin]
            used[bin_ + k // per_bin] |= places
    assert all(u == set(range(len(u))) and len(u) <= capacity for u in used)
    assert (bins, sorted(capacity - len(u) for u in used)) == plain_best_fit(lengths, capacity)


def test_the_plan_does_not_grow_with_the_table():
    few, _ = bestfit.best_fit({n: 3 for n in range(1, 2049)}, 2048)
    many, _ = bestfit.best_fit({n: 3_000_000_000 for n in range(1, 2049)}, 2048)
    assert len(many) < 4 * 2048 * 3 and len(few) < 4 * 2048 * 3


def test_rooms_find_the_tightest():
    rooms, held = bestfit.Rooms(100), set()
    rng = random.Random(1)
    for _ in range(2000):
        r = rng.randint(0, 100)
        rooms.add(r, -1 if r in held else 1)
        held ^= {r}
        need = rng.randint(0, 100)
        assert rooms.tightest(need) == min((x for x in held if x >= need), default=None)


def test_every_token_merges_to_itself():
    """Then merging by the rank of what comes out is merging by the rank of the pair."""
    model = json.load(open(PATH))["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    for word in model["vocab"]:
        end = word.endswith("</w>") and len(word) > 4
        parts = list(word[:-4] if end else word)
        parts[-1] += "</w>" if end else ""
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 40))
            assert (parts[k], parts[k + 1]) in rank, word
            parts[k : k + 2] = ["".join(parts[k : k + 2])]


ODD_TEXTS = ["a\x1cb c\x0bd\x0ce\x85f\xa0g h J̌́ x ́ İ İΣ ΟΔΟΣ Kk  ​z <|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "it's'S we'LL \t'll", "x\x00y", "힣각가", "a" * 100 + " b", "é" * 70, "１２3 ½ ² ª º µ", "a　b c﻿d᠎e", "ÀÉÎÕÜß ×÷ ÞþÐðŸÿ Á1²a ¿que! ¡no", "é É́cole"]


def test_ids_are_the_tokenizers_ids(sf):
    import pyarrow.parquet as pq

    encode = bestfit.WordEncoder(PATH)
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist() if t] + ODD_TEXTS + [" " * 3_000_000, "a" + " \n" * 1_500_000 + "b"]
    for text in texts:
        assert encode(text) == np.array(encode.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:50]


@pytest.mark.parametrize("parts", [1, 7])
def test_pieces_hold_every_id_once_in_as_few_sequences(spark, sf, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("piece"), F.lit("clash").alias("length"))
    docs = docs.union(spark.createDataFrame([(-1, None, 1, ""), (-2, "", 1, ""), (-3, "wort " * 9000, 1, ""), (-4, " " * 100_000, 1, "")], docs.schema)).repartition(parts)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bestfit.pack_best_fit(docs, PATH).collect()
    encode, ids = bestfit.WordEncoder(PATH), {}
    for doc, text in texts.items():
        ids[doc] = encode(text or "") + b"\0\0\0\0"
    lengths, places = [], {}
    for r in rows:
        assert r.start == 2048 * r.piece and r.length == min(2048, len(ids[r.doc_id]) // 4 - r.start)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        lengths.append(r.length)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(lengths) * 4 == sum(map(len, ids.values())) and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) == plain_best_fit(lengths, 2048)[0]


def test_packing_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = bestfit.pack_best_fit(rows, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 3), (1, 3), (1, 3), (2, 1)] and len({r.sequence_id for r in got}) == 1
    assert bestfit.pack_best_fit(rows.limit(0), PATH).collect() == []


# --- collocations ------------------------------------------------------------------------------


def plain_phrases(rows, least, most, percent=50):
    counts, n, out = {}, Counter(), []
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= percent * a for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), a, l, r, n[lang], -s) for i, (s, _, p, a, l, r) in enumerate(sorted(kept)[:most])]
    return sorted(out)


def told(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("bits,hot_share,most", [(12, 1, 2000), (16, 10**6, 2000), (24, 1000, 7)])
def test_phrases_equal_counting_all(spark, bits, hot_share, most):
    """Few buckets, so that most collide; all parts hot, none hot."""
    rng, words = random.Random(5), ["alpha", "Beta", "gamma", "δέλτα", "x-1", "y z", "q\x1cq"] + [f"w{i}" for i in range(60)]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(words[:7] if rng.random() < 0.5 else words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randint(0, 200)))) for _ in range(150)]
    rows += [("en", "the hot phrase " * 4000), ("fr", None), ("fr", ""), (None, ". , ;"), ("xx", "alone")]
    df = spark.createDataFrame([(i % 50, text, lang, "s") for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string, n string").withColumn("phrase", F.lit("clash")).repartition(5)
    got = told(collocations.mine(df, least=5, bits=bits, hot_share=hot_share, most=most))
    assert got == plain_phrases(rows, 5, most) and len(got) > 10


def test_phrases_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.mine(df, bits=12).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, None, None), (2, " \t.", "en")], df.schema), bits=12).collect() == []


def test_buckets_are_exact_at_the_threshold(spark):
    """255 and more of one bucket in many tasks, and counts that reach the threshold only together."""
    h = np.array([7 << 52, 9 << 52, 11 << 52], np.uint64)

    def run(batches):
        for batch in batches:
            b = collocations.Buckets(12)
            b.add(np.repeat(h, [300, 1, 2]))
            yield b.batch().to_pandas()

    counts = spark.range(0, 5, 1, 5).mapInPandas(run, collocations.PARTIAL)
    for least, want in ((5, [True, True, True]), (6, [True, False, True]), (11, [True, False, False]), (255, [True, False, False])):
        assert collocations.has(collocations.bitmap(counts, 12, least).value, 12, h).tolist() == want


# --- hard negatives ----------------------------------------------------------------------------


def plain_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256):
    own = {}
    for i, vec, label in rows:
        if i is not None and label is not None and vec is not None and all(x is not None and np.isfinite(x) for x in vec):
            key = (label, [float(np.floor(scale * float(x))) for x in vec])
            own[i] = min(own.get(i, key), key)
    width = max((len(v) for _, v in own.values()), default=0)
    full = {i: (label, np.array(v + [0.0] * (width - len(v))).astype(np.int64)) for i, (label, v) in own.items()}
    out = []
    for a in sorted(i for i in full if anchors(i)):
        scored = sorted((-int(full[a][1] @ v), i, label == full[a][0]) for i, (label, v) in full.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(t, i) for t, i, same in scored if not same and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit)]
    return out


@pytest.mark.parametrize("options", [{}, {"page_rows": 20, "block_rows": 5, "sample_rows": 50}, {"page_rows": 1, "block_rows": 1, "sample_rows": 3}])
def test_negatives_equal_brute_force(spark, options):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    rows = [(i, [float(x) for x in (centre[i % 4] + rng.normal(size=6) * rng.choice([0.1, 1.0])) * rng.choice([0.3, 1.0, 2.0])], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6, i % 3) for i in range(150)]  # copies of one vector
    rows += [(2000 + i, [0.0] * 6, 1) for i in range(3)] + [(2010, [0.5] * 4, 1), (None, [1.0] * 6, 1), (2020, None, 1), (2030, [1.0, None] * 3, 1), (2040, [float("nan")] * 6, 2), (2050, [1.0] * 6, None), (20, [0.1] * 6, 0), (20, [0.1] * 6, 0), (2060, [float("inf")] * 6, 0), (2070, [0.3] * 6, 99)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("cell", "page", "rank", "anchor", "cap", "positive", "vec"):
        df = df.withColumn(name, F.lit("clash"))
    got = hardneg.hard_negatives(df.repartition(3), F.col("vec_id") % 10 == 0, **options)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 500
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(df, F.col("vec_id") % 10 == 0).collect() == []
    assert hardneg.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], df.schema), F.col("vec_id") % 10 == 0).collect() == []
    assert hardneg.hard_negatives(spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 1)], df.schema), F.col("vec_id") % 10 == 0).collect() == []


def test_pages_far_from_a_group_are_not_copied():
    """Bounds tell which pages a block needs: of two far clusters only the near one."""
    rng = np.random.default_rng(0)
    near, far = rng.normal(size=(50, 8)), rng.normal(size=(50, 8)) + 100
    both = np.round(np.concatenate([near, far]) * 10)
    space = hardneg.Space(float((both * both).sum(axis=1).max()))
    pivots = space.point(both[[0, 50]])
    t = np.zeros(1, hardneg.TARGET)
    t["anchor"], t["cap"], t["floor"], t["same"] = -1, np.inf, -np.inf, True
    join = hardneg.Join(t.tobytes(), both[60:61].tobytes(), 8, 5, space, pivots, (np.arange(100), np.zeros(100, np.int64), both))
    reach = [hardneg.distances(space.point(part), pivots[k : k + 1])[:, 0] for k, part in enumerate((both[:50], both[50:]))]
    assert join.able(0, reach[0].min(), reach[0].max())[0] < 0 <= join.able(1, reach[1].min(), reach[1].max())[0]


def test_additive_misses_nothing_far_from_the_origin_or_beside_far_off_rows(spark):
    """Rows far from the origin, of very different lengths, or beside a few that are a million times longer: the ten nearest are found all the same."""
    import numpy as np
    from tessera.llm import additive

    rng = np.random.default_rng(3)
    g = rng.normal(size=(1500, 16))
    shapes = [1000 + g, g * np.exp(2 * rng.normal(size=(1500, 1))), np.where(np.arange(1500)[:, None] % 300 == 1, 1e6 * g, g)]
    for x in shapes:
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = additive.nearest_neighbours(df, F.col("vec_id") % 100 == 0, page_rows=200, sample_rows=500, rerank=20).collect()
        for q in range(0, 1500, 100):
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
            assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
