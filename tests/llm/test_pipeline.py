"""The pipeline against its stages done plainly, one after the other."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.mixing import mix
from tessera.llm.queries import tokenizer_path
from tessera.llm.secrets import redact_text, scan
from tests.llm.test_operators import plain_set


def keep_one_of_each_group(rows):
    """By the stage's own measure: five words and 80 percent."""
    sets = {r.doc_id: plain_set(r.text, 5) for r in rows}
    root = {r.doc_id: r.doc_id for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(root)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, "12 !!", "en", "src0", 5), (10**6 + 3, "the token = \"" + "ab12" * 8 + "\" of the ing", "en", "src1", 9)], docs.schema)
    now = docs.unionByName(extra)
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        out = stage(spark, now, sf)
        if name != "packing":
            assert out.columns == columns
            now = spark.createDataFrame(out.collect(), docs.schema)
        after = now.collect()
        if name == "language":
            with_letters = {r.doc_id for r in before if r.text and re.search(r"[^\W\d_]", r.text)}
            assert {r.doc_id for r in after} <= with_letters
            assert len(after) >= 0.98 * len(with_letters)
        elif name == "near_duplicates":
            assert {r.doc_id for r in after} == keep_one_of_each_group(before)
            assert len(after) == len({r.doc_id for r in after})
        elif name == "secrets":
            assert {(r.doc_id, r.text) for r in after} == {(r.doc_id, redact_text(r.text)) for r in before}
            assert not any(scan(r.text)[1] for r in after) and all(r.n_chars == len(r.text) for r in after)
        elif name == "mixing":
            have, taken = {r.doc_id: r for r in before}, {r.doc_id: (r.taken, r["size"]) for r in mix(spark.createDataFrame(before, docs.schema)).collect()}
            assert all(r == have[r.doc_id] for r in after)
            assert Counter(r.doc_id for r in after) == {d: max(1, t // n) for d, (t, n) in taken.items() if t}
        else:
            pieces = out.collect()
            encode, want, got = Tokenizer.from_file(tokenizer_path()), Counter(), Counter()
            for r in before:
                ids = [*encode.encode(r.text or "", add_special_tokens=False).ids, 1]
                want.update((r.doc_id, i, t) for i, t in enumerate(ids))
            texts = {r.doc_id: [*encode.encode(r.text or "", add_special_tokens=False).ids, 1] for r in before}
            for p in pieces:
                ids = texts[p.doc_id][p.start : p.start + p.length]
                assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(texts[p.doc_id])
                got.update((p.doc_id, p.start + i, t) for i, t in enumerate(ids))
            assert got == want
            for s in {p.sequence_id for p in pieces}:
                own = sorted((p.offset, p.length) for p in pieces if p.sequence_id == s)
                assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048


def test_run_repeats_and_takes_an_empty_table(spark, sf, tmp_path):
    a = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    assert a and corpus_pipeline.ORACLE_SQL is None
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_are_told_by_five_words_at_80_percent(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    more = [f"x{rng.randrange(10**6)}" for _ in range(300)]
    texts = {1: words, 2: words + more[:200], 3: words + more[:270], 4: more, 5: words[:500] + ["other"] + words[500:], 6: more[:28] + ["y"] + more[29:], 7: more[:60] + ["y"] + more[61:150] + ["z"] + more[151:220] + ["v"] + more[221:], 8: [], 9: ["a", "b"], 10: ["a", "b"]}
    sets = {i: {tuple(t[j : j + 5]) for j in range(max(1, len(t) - 4))} if t else set() for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert root[2] == 1 and root[10] == 9 and root[4] == 4
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(root.values()))


def test_components_of_one_repeated_id_each_keep_a_row(spark):
    rng = random.Random(6)
    one, two, three = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, one), (2, one), (1, two), (3, two), (1, two), (4, three), (5, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == sorted([(1, one), (1, two), (4, three), (5, ""), (5, "")])


def test_stages_on_odd_tables(spark):
    """Nulls everywhere, repeats, a very long text, no rows at all, and columns named like the stages' own."""
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, "the ing and thre " * 30_000, "en", "a", None), (3, "the ing and thre", "en", None, 16), (3, "the ing and thre", "en", None, 16), (4, "die und ein der", None, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("language", "tie", "taken", "size", "doc", "shard", "kind", "group"):
        docs = docs.withColumn(name, F.lit("clash"))
    # repeats of 1 and of 3 stay once; the empty text without an id stays; 2 (four shingles of five words) and 3 (one of four) share none
    counts = {"language": 4, "near_duplicates": 5, "secrets": 7}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert name == "packing" or out.columns == docs.columns
        assert out.count() == counts.get(name, out.count()), name
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4]
        assert stage(spark, docs.limit(0), "").count() == 0
