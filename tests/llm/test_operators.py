"""Each operator against a plain version on small tables, and on nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import additive, jaccard, langid, mixing, mtree, packing, toxicity, warc
from tessera.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.oracle import connect, differences

LONG = "palabra wort word mot " * 9000
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, LONG, "en", "b"), (3, LONG, "en", "b"), (3, "other text of this id", "de", None), (None, "no id at all", "fr", ""), (4, "same text here now", "en", "a"), (5, "same text here now", "en", "a"), (6, "123 456 !!!", "en", "a"), (7, "  \t\n ", "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns named like the operators' own."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    for name in ("size", "shard", "score", "target", "vid", "tile", "n", "f", "p", "held_out", "order", "tie", "first", "page", "family"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


# --- mixing ------------------------------------------------------------------------------------


def plain_seats(votes, seats, caps):
    won = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in zip(votes, caps) if v > 0))):
        best = max((v / (2 * w + 1), -i) for i, (v, w, c) in enumerate(zip(votes, won, caps)) if w < c and v > 0)
        won[-best[1]] += 1
    return won


@pytest.mark.parametrize("votes,seats,caps", [([5.0, 3.0, 1.0], 7, [9, 9, 9]), ([10.0, 10.0, 10.0], 5, [9, 9, 1]), ([0.0, 4.0], 3, [9, 9]), ([1.5, 2.5, 3.5, 9.0], 40, [3, 50, 5, 50]), ([], 3, []), ([2.0], 9, [4])])
def test_highest_quotients(votes, seats, caps):
    assert mixing.sainte_lague(votes, seats, caps) == plain_seats(votes, seats, caps)


def test_water_fill_stops_at_three_times_the_size():
    assert mixing.water_fill([100, 100, 1], [1, 2, 3]) == pytest.approx([66.0, 132.0, 3.0])
    assert mixing.water_fill([0, 0], [1, 2]) == [0.0, 0.0]


def test_mix_keeps_to_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs, rows_per_shard=16).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault((r.target, r.source_size), []).append(r)
    for (target, source_size), own in by.items():
        assert sum(r.taken for r in own) == pytest.approx(target, rel=0.05) or len(own) != docs.count()
    assert sum(r.taken for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.02)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7), rows_per_shard=16).collect()))


def plain_mix(docs, shard_of, order_of, rows_per_shard, max_block=1024, seed=17):
    """What a mix takes, seat by seat and word by word; hashes are given."""
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d[2] or "")) for i, d in enumerate(docs)}
    names = sorted({d[1] for d in docs}, key=lambda s: (s is None, s or ""))
    size = [sum(words[i] for i, d in enumerate(docs) if d[1] == s) for s in names]
    target, done = [0.0] * len(names), set()
    while len(done) < len(names):
        left = sum(size) - sum(target[i] for i in done)
        level = left / sum(j % 3 + 1 for j in range(len(names)) if j not in done)
        share = {i: level * (i % 3 + 1) for i in range(len(names)) if i not in done}
        full = [i for i in share if share[i] > 3 * size[i]]
        for i in full or share:
            target[i] = float(3 * size[i]) if full else share[i]
        done |= set(full or share)
    block = max(1, min(max_block, sum(size) // 4096))
    unit = [block if t >= 64 * block else 1 for t in target]
    rings = {}
    for i, d in enumerate(docs):
        if words[i]:
            rings.setdefault((names.index(d[1]), shard_of[i]), []).append(i)
    length = {k: sum(words[i] for i in v) for k, v in rings.items()}
    cap = {k: 3 * n // unit[k[0]] for k, n in length.items()}
    full_cap = [sum(c for k, c in cap.items() if k[0] == s) for s in range(len(names))]
    large = [s for s in range(len(names)) if unit[s] == block]
    won = dict(zip(large, plain_seats([target[s] for s in large], round(sum(target[s] for s in large) / block), [full_cap[s] for s in large])))
    taken = [0] * len(docs)
    for s in range(len(names)):
        seats = won.get(s, min(full_cap[s], round(target[s])))
        n = sum(d[1] == names[s] for d in docs)
        shards = max(1, min(-(-n // rows_per_shard), size[s] // (64 * unit[s])))
        lots = {}
        for k in sorted(k for k in rings if k[0] == s):
            lots.setdefault(k[1] % math.ceil(math.sqrt(shards)), []).append(k)
        lots = [lots[x] for x in sorted(lots)]
        for own, q in zip(lots, plain_seats([float(sum(length[k] for k in o)) for o in lots], seats, [sum(cap[k] for k in o) for o in lots])):
            for k, w in zip(own, plain_seats([float(length[k]) for k in own], q, [cap[k] for k in own])):
                ring = [i for i in sorted(rings[k], key=lambda i: (order_of[i], docs[i][0])) for _ in range(words[i])]
                at = START(seed + 2, *k) % -(-len(ring) // unit[s]) * unit[s]
                for step in range(w * unit[s]):
                    taken[ring[(at + step) % len(ring)]] += 1
    return taken


@pytest.mark.parametrize("max_block", [4, 1024])
def test_mix_equals_blocks_taken_one_by_one(spark, max_block):
    rng = np.random.default_rng(3)
    docs = [(i, [None, "a", "a", "a", "b", "tiny", "z"][int(rng.integers(0, 7)) if i > 3 else 5 if i == 3 else 1], " ".join(["w"] * int(rng.integers(0, 60)))) for i in range(400)]
    docs = [(i, "c" if s == "tiny" and i != 3 else s, "three words only" if s == "tiny" and i == 3 else t) for i, s, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix(df, rows_per_shard=8, max_block=max_block).collect()}
    order = {r.doc_id: r.o for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")).alias("o")).collect()}
    global START
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    pairs = sorted({(names.index(s), got[i].shard) for i, s, _ in docs})
    told = spark.createDataFrame(pairs, "src int, shard long").select("src", "shard", F.xxhash64(F.lit(19), "src", "shard").alias("h")).collect()
    hashes = {(r.src, r.shard): r.h for r in told}
    START = lambda seed, src, shard: hashes[(src, shard)]
    want = plain_mix(docs, {i: got[i].shard for i in got}, order, 8, max_block)
    assert [got[i].taken for i in range(len(docs))] == want
    for s in names:
        own = [got[i] for i, src, _ in docs if src == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, 0.02 * own[0].target)


def test_a_tiny_source_leaves_the_blocks_whole(spark):
    rows = [(i, "big" if i % 2 else "other", "w " * 3000) for i in range(1500)] + [(9000, "tiny", "just three words")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sum(r.taken for r in got if r.doc_id == 9000) == 9
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.shard), []).append(r.taken)
    assert all(sum(v) % 1024 == 0 for (size, _), v in by.items() if size > 3)
    assert sum(r.taken for r in got) == pytest.approx(sum(r["size"] for r in got), rel=0.01)


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert {r.doc_id for r in rows if r["size"] == 0} == {1, 2, 7}
    assert mixing.mix(odd.limit(0)).count() == 0
    carried = mixing.mix(odd, carry=True).select("doc.*")
    assert carried.columns == odd.columns and carried.count() == len(ODD)


# --- packing -----------------------------------------------------------------------------------


def test_fast_ids_are_the_tokenizers_ids(spark, sf):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path())
    fast = packing.Encoder(tokenizer_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ["a<|endoftext|>b", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", " <|endoftext|>\n", "<|endoftext|", "  x\n\n y\t", "é😀字", "don't WE'LL", "\x00\x7f"]
    for text in texts:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    encode = packing.Encoder(tokenizer_path())
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*(encode(r.text).tolist() if r.text else []), 1])
    sequences, pieces = {}, {}
    rows = packing.pack(docs, tokenizer_path(), window=1 << 16).collect()
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (doc_id, n), own in pieces.items():
        held = [ids for ids in want[doc_id] if len(ids) == n]
        assert sum(r.length for r in own) == n * len(held)
        for r in own:
            assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in held)
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert total <= 2048 and total & (total - 1) == 0
    groups = {}
    for s, own in sequences.items():
        groups.setdefault(own[0].step_group, set()).add(s)
    assert max(map(len, groups.values())) <= 16
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 3_000_000, "a" + " " * 3_000_000 + "b", "word " * 10 + "\t " * 1_500_000 + "<|endoftext|> z"], ids=["spaces", "newlines", "between", "mixed"])
def test_very_long_white_space(text):
    encode = packing.Encoder(tokenizer_path())
    assert encode(text).tolist() == encode.slow.encode(text, add_special_tokens=False).ids


def test_very_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_500_000 + "b"), (2, "c")], "doc_id long, text string")
    rows = packing.pack(docs, tokenizer_path()).collect()
    want = len(packing.Encoder(tokenizer_path()).slow.encode("a" + " " * 1_500_000 + "b", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows if r.doc_id == 1) == want


# --- n-gram Jaccard ----------------------------------------------------------------------------


def plain_set(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows) if d is not None) + [(None, len(sets[i]), None) for i, (d, _) in enumerate(rows) if d is None]


def near_copies():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    passage = [words[i] for i in rng.integers(0, 3000, 60)]
    out = []
    for family in range(6):
        base = [words[i] for i in rng.integers(0, 3000, int(rng.integers(8, 300)))]
        for _ in range(14):
            own = base.copy()
            for at in rng.integers(0, len(own), int(rng.integers(0, max(2, len(own) // 25)))):
                own[at] = words[int(rng.integers(0, 3000))]
            out.append((len(out), " ".join(own)))
    out += [(len(out) + i, " ".join(passage + [words[j] for j in rng.integers(0, 3000, 50)])) for i in range(40)]
    return out


@pytest.mark.parametrize("chunk,leaders", [(1024, 64), (16, 64), (8, 2)])
def test_components_equal_all_pairs(spark, chunk, leaders):
    """In whole cells, and in cells so small that most rows meet leaders only."""
    rows = near_copies()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, leaders=leaders)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(rows)


def test_long_chains_of_near_copies(spark):
    """Each row links to its neighbours only, so a family's ends are far from each other and from any leader."""
    rng = np.random.default_rng(14)
    words, rows = [f"w{i}" for i in rng.integers(0, 10**6, 160)], []
    for i in range(90):
        rows.append((i, " ".join(words)))
        words[int(rng.integers(0, 160))] = f"x{i}"
        if i % 3 == 0:
            words[int(rng.integers(0, 160))] = f"y{i}"
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), chunk=8, leaders=3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(rows)


def test_components_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect()]
    assert sorted(got, key=repr) == sorted(plain_components([(d, t) for d, t, *_ in ODD]), key=repr)
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, int(rng.integers(5, 120))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(rng.integers(0, 400, int(rng.integers(5, 120))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        width = min(len(x), len(y))
        apart = int(np.bitwise_count(jaccard.folded(x, width) ^ jaccard.folded(y, width)).sum())
        assert (len(a) + len(b) - apart) // 2 >= jaccard.overlap(a, b) == len(set(a.tolist()) & set(b.tolist()))


# --- language and toxicity -----------------------------------------------------------------------


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 6, 7))
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More languages than any limit there was; each has an alphabet of its own."""
    rows = [(10 * n + i, "".join(chr(0x4E00 + 3 * n + (i + j) % 3) for j in range(30)), f"l{n:03d}") for n in range(401) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 401
    right = sum(model.predict(t)[0] == lang for _, t, lang in rows[::7])
    assert right >= 0.9 * len(rows[::7])


def test_repeated_rows_leave_the_sample_whole(spark, monkeypatch):
    """20,000 copies of one row: the others are sampled as if it were there once, whatever its hash."""
    sizes = []
    monkeypatch.setattr(langid, "train_ftrl", lambda model, data: sizes.append(len(data)))
    monkeypatch.setattr(langid, "calibrate", lambda model, data: sizes.append(len(data)))
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of row "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    for copied in (1, 2, 3, 4):
        copies = rows.where(F.col("doc_id") == copied).crossJoin(spark.range(20_000).select()) if copied else rows
        langid.fit(rows.union(copies.select("doc_id", "text", "lang")), sample_docs=500)
        assert 400 <= sizes.pop() + sizes.pop() <= 600


def test_long_texts_are_described_alike_in_training():
    at, counts = langid.grams("ab" * 100_000)
    assert counts.max() > 65_535


def plain_probabilities(model, text):
    """The model's formula, n-gram by n-gram."""
    counts = {}
    at, n = langid.grams(text)
    for a, c in zip(at.tolist(), n.tolist()):
        counts[a] = counts.get(a, 0) + c
    tfidf = {a: (1 + math.log(c)) * float(model.idf[a]) for a, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in tfidf.values()))
    z = [(sum(v / norm * float(model.weights[a, k]) for a, v in tfidf.items()) + float(model.bias[k])) / model.temperature for k in range(len(model.langs))]
    return [math.exp(v - max(z)) / sum(math.exp(u - max(z)) for u in z) for v in z]


def test_language_scores_equal_the_formula(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    model = langid.fit(docs)
    for r, s in zip(sorted(docs.collect(), key=lambda r: r.doc_id), sorted(langid.identify(docs, model).collect(), key=lambda r: r.doc_id)):
        if s.lang_pred != "und":
            p = plain_probabilities(model, r.text)
            assert s.lang_pred == model.langs[int(np.argmax(p))] and s.score == pytest.approx(max(p), rel=1e-4)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    pairs = [(a.score, b.score) for a in rows if a.toxic for b in rows if not b.toxic]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.9


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_isotonic_curve_rises_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    p = rng.random(200)
    y = (rng.random(200) < p).astype(float)
    x, v = toxicity.isotonic(p, y)
    assert (np.diff(v) > 0).all() and (np.diff(x) > 0).all() and 0 <= v.min() and v.max() <= 1


# --- vectors -------------------------------------------------------------------------------------


def vectors(spark, n=700, dim=12):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=dim)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)] + [(5, rows[9][1]), (None, rows[1][1]), (2000, None), (2001, [1.0, None]), (2002, [float("nan")] * dim), (2003, [float("inf")] * dim), (2004, [0.0] * dim), (2020, [3.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", F.lit("clash")).withColumn("page", F.lit("clash"))


def usable_rows(df, zero):
    out = [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]
    return [(i, v + [0.0] * (12 - len(v))) for i, v in out if zero or any(v)]


def test_mtree_equals_brute_force(spark):
    df = vectors(spark)
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in usable_rows(df, True)]
    got = {}
    for r in mtree.top_products(df, F.col("vec_id") % 20 == 0, page_rows=128, block_rows=8, sample_rows=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = {i: v for i, v in rows if i % 20 == 0}
    assert set(got) == set(asked)
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:20]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert mtree.top_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_additive_recall_and_measure(spark):
    df = vectors(spark)
    rows = usable_rows(df, False)
    got = additive.nearest_neighbours(df, F.col("vec_id") % 20 == 0, page_rows=128, sample_rows=500, rerank=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, v in rows:
        if q % 20 == 0:
            exact = {}
            for i, w in rows:
                if i != q:
                    exact.setdefault(i, []).append(math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))))
            near = sorted((d, i) for i, ds in exact.items() for d in ds)[:10]
            own = sorted(by[q], key=lambda r: r["rank"])
            assert len(own) == 10 and all(min(abs(r.score - d) for d in exact[r.vec_id]) < 1e-9 for r in own)
            assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
            hits += len({i for _, i in near} & {r.vec_id for r in own})
            total += len({i for _, i in near})
    assert hits >= 0.9 * total
    assert additive.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_additive_recall_among_copies(spark):
    """A third of all rows is one vector, in ids from end to end; the smallest ids of it count, and the rest is found beside it."""
    rng = np.random.default_rng(11)
    copied, near = rng.normal(size=16), rng.normal(size=(4, 16))
    rows = [(i, (copied if i % 3 == 1 else copied + near[i % 4] * 0.3 + rng.normal(size=16) * 0.2).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = additive.nearest_neighbours(df, F.col("vec_id") % 25 == 0, page_rows=300, sample_rows=500, rerank=40).collect()
    data, hits = np.array([v for _, v in rows]), 0
    for q in range(0, 900, 25):
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert q % 3 != 1 or own == want
        hits += len(set(own) & set(want))
    assert hits >= 0.95 * 360


# --- web archives --------------------------------------------------------------------------------

RECORDS = [
    (1, "http://WWW.A.com/x/?b=2&a=1&utm_source=z#f", 10, "response", '"e1"', "d1", {"etag": '"e1"', "content-type": "text/html", "date": "1"}),
    (2, "https://a.com/x?a=1&b=2", 20, "revisit", 'W/"e1"', None, {"date": "2", "content-type": "x", "expires": "9"}),
    (3, "https://a.com/x?a=1&b=2", 10, "revisit", '"e1"', None, None),
    (4, "https://a.com/x?a=1&b=2", 30, "revisit", '"e2"', "d1", {"date": "3"}),
    (5, "https://a.com/x?a=1&b=2", 30, "revisit", None, "d1", {"date": "4"}),
    (6, "https://a.com/x?a=1&b=2", 30, "revisit", None, None, {"date": "5"}),
    (7, "https://b.org", 30, "revisit", '"e1"', None, {"date": "6"}),
    (8, None, 30, "revisit", '"e1"', None, {}),
    (9, "https://a.com/x?a=1&b=2", None, "revisit", '"e1"', None, {}),
    (10, "https://a.com/x?a=1&b=2", 25, "response", '"e2"', "d2", {"etag": '"e2"'}),
    (11, "https://a.com/x?a=1&b=2", 25, "response", '"e3"', "d1", None),
]
RECORD = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"


@pytest.mark.parametrize("per", [1, 50_000])
def test_revisits(spark, per):
    df = spark.createDataFrame(RECORDS, RECORD).withColumn("own", F.lit("clash")).withColumn("bucket", F.lit("clash"))
    got = {r.record_id: r for r in warc.resolve_revisits(df, rows_per_bucket=per).collect()}
    assert {k: (r.response_id, r.status) for k, r in got.items()} == {2: (1, "resolved"), 3: (None, "missing"), 4: (11, "mismatch"), 5: (11, "resolved"), 6: (11, "unverified"), 7: (None, "missing"), 8: (None, "missing"), 9: (None, "missing")}
    assert got[2].headers == {"etag": '"e1"', "content-type": "text/html", "date": "2", "expires": "9"}
    assert got[4].headers == {"date": "3"} and got[3].headers == {}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize("quantiles", [2, 512])
def test_one_hot_url_over_many_buckets(spark, quantiles):
    """More buckets than quantiles, ties, and gaps longer than a bucket; every revisit against a plain search. A clashing column is ignored."""
    rng = np.random.default_rng(8)
    times = np.concatenate([rng.integers(0, 50, 60), rng.integers(10**6, 10**6 + 9, 60), [5] * 20]).tolist()
    rows = [(i, "http://hot.org/" if i % 10 else f"http://u{i % 7}.org", int(t), "response" if rng.random() < 0.3 else "revisit", f"e{i % 3}", None, {"n": str(i)}) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, RECORD).withColumn("url_key", F.lit("clash")).withColumn("near", F.lit("clash"))
    got = {r.record_id: r.response_id for r in warc.resolve_revisits(df, rows_per_bucket=1, quantiles=quantiles).collect()}
    want = {i: max(((t2, j) for j, u2, t2, k2, *_ in rows if k2 == "response" and u2 == u and t2 < t), default=(0, None))[1] for i, u, t, k, *_ in rows if k == "revisit"}
    assert got == want


# --- queries -------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), ORACLES[name], connect(sf)) is None


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
