"""Tokens, languages, quality, fingerprints and near duplicates against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arboris.llm import bpe, langid, neardup, quality, sketch
from arboris.llm.common import WORD, held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string"
LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c d e"), (6, "A  b\nc d E"), (7, LONG), (8, LONG), (9, "!?"), (9, "!?"), (None, "zz yy"), (11, "naïve 中文 😀 ٣")]


def docs(spark, rows):
    """Documents with an extra column whose name operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in rows], SCHEMA)


def words(rng, n, k=300):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.index_at) == list(range(3000)) and all(h.get(k) == i for i, k in enumerate(keys))
    assert h.get(b"other") == -1 and bpe.PerfectHash([]).get(b"x") == -1


@pytest.fixture(scope="module")
def vocabulary():
    tok = pytest.importorskip("public_tokenizers")
    return str(tok.path("byte_bpe_multi_50k.tiktoken")), tok.PATTERN


def test_bpe_equals_the_library(vocabulary):
    import base64

    import tiktoken

    path, pattern = vocabulary
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(bpe.Vocabulary.read(path, pattern))
    rng = random.Random(3)
    letters = "aAbstTheré ß中文😀\n\t  1239.,!'#\x1c\x85\xa0"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()
    with pytest.raises(ValueError):
        codec.decode([10**7])


def test_bpe_columns(spark, vocabulary):
    df = docs(spark, ODD)
    both = bpe.decode(bpe.encode(df, *vocabulary), *vocabulary)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in both.collect())
    digests = bpe.round_trip(df, *vocabulary).collect()
    assert len(digests) == len(ODD) and {r["n_tokens"] for r in digests if r["doc_id"] in (1, 2)} == {0}
    assert all(r["decoded_sha256"] == hashlib.sha256((dict(ODD)[r["doc_id"]] or "").encode()).hexdigest() for r in digests)
    assert bpe.round_trip(df.limit(0), *vocabulary).count() == 0


def test_language_mixtures(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ba", "bo", "bi"], "bb": ["ket", "kul", "kor"], "cc": ["zzy", "zxa", "zqo"]}

    def text(lang, n=60):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))

    rows = [(i, text(lang), lang, "s", 0, "") for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    train = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(train.where(~held_out(train["doc_id"])))
    got = langid.predict(train, model).collect()
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.95 for r in got) and "ids" in got[0].asDict()
    mix = langid.predict(docs(spark, [(1, text("aa", 60) + " " + text("bb", 30)), *ODD]), model).collect()
    assert mix[0]["lang_pred"] == "aa" and set(mix[0]["languages"]) == {"aa", "bb"} and abs(mix[0]["score"] - 2 / 3) < 0.1
    assert {r["lang_pred"] for r in mix if r["text"] is None or not any(c.isalpha() for c in r["text"])} == {"und"}
    signs = langid.predict(docs(spark, [(1, "² ½ ³"), (2, "⑤"), (3, "٣ 12"), (4, "ª")]), model).collect()
    assert [r["lang_pred"] == "und" for r in signs] == [True, True, True, False]
    empty = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in langid.predict(train, empty).collect()} == {"und"}
    assert langid.predict(train.limit(0), model).count() == 0


def test_mixture_beats_no_grid_point():
    """The proportions found are at least as likely as any on a grid."""
    rng = np.random.default_rng(2)
    like = rng.dirichlet(np.ones(20), 2).T
    c = rng.multinomial(500, 0.3 * like[:, 0] + 0.7 * like[:, 1]).astype(float)[None]
    pi = langid.proportions(c, like, 0.0)[0]
    best = max((c[0] * np.log(like @ np.array([p, 1 - p]))).sum() for p in np.linspace(0.01, 0.99, 99))
    assert (c[0] * np.log(like @ pi)).sum() >= best - 1e-2


def test_quality_votes(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 40) if i % 3 else words(rng, 40).upper().replace(" ", "!! "), "en", "s", 0, "") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None), (0, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels.where(~held_out(labels["doc_id"])))
    got = quality.predict(df, model).where(held_out(F.col("doc_id"))).collect()
    assert len(got) > 40 and all((r["score"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in got)
    odd = quality.predict(docs(spark, ODD), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    nothing = quality.fit(df, labels.limit(0))
    assert {r["score"] for r in quality.predict(df, nothing).collect()} == {0.5}


def test_quality_sees_what_is_said(spark):
    """Words of the same shape, good and bad, and texts that say one word over and over."""
    rng = random.Random(14)
    good = lambda: " ".join(rng.choice(["stone", "river", "light", "house", "grass"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["xqzvk", "zzkqx", "vxxqj", "kjqzv", "qvkxz"]) for _ in range(40))
    rows = [(i, good() if i % 3 == 0 else bad() if i % 3 == 1 else " ".join([f"w{i:04}"] * 40), "en", "s", 0, "") for i in range(240)]
    df = spark.createDataFrame([*rows, *rows[:20]], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int")
    model = quality.fit(df, labels.where(~held_out(labels["doc_id"])))
    got = quality.predict(df, model).where(held_out(F.col("doc_id"))).collect()
    assert len(got) > 40 and all((r["score"] >= 0.7) == (r["doc_id"] % 3 == 0) for r in got)
    again = quality.fit(df.repartition(5), labels.where(~held_out(labels["doc_id"])))
    assert (again.vectors == model.vectors).all()


def test_quality_cosines_are_exact():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.01, (40, quality.FEATURES)).astype(np.float32)
    labels = rng.integers(0, 2, 40)
    m = quality.Model(counts, labels, 16)
    got = m.score(counts[:5], 7)
    v = m._unit(m._weigh(counts[:, m.used]) @ m.project)
    for i in range(5):
        cos = v @ v[i]
        near = sorted(range(40), key=lambda j: -cos[j])[:7]
        w = [max(cos[j], 0) ** 4 for j in near]
        assert abs(got[i] - sum(a * labels[j] for a, j in zip(w, near)) / sum(w)) < 1e-4


def shingles(text, lower=False):
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(WORD, text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_sketches(spark):
    rng = random.Random(5)
    rows = [(i * 7, words(rng, rng.randrange(1, 400))) for i in range(120)] + [(3, None), (4, ""), (5, "x"), (1000, LONG)]
    for ranges in (1, 6):
        got = {r["doc_id"]: r for r in sketch.edited_fingerprints(docs(spark, rows), ranges).collect()}
        order = sorted(rows)
        assert len(got) == len(rows)
        for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
            text, after = text or "", after or ""
            edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
            assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
            a, b = shingles(text), shingles(edited)
            if len(a) > 200:
                assert abs(got[i]["near_edited"] - len(a & b) / len(a | b)) < 0.25
            own, new, then = (set(re.findall(".{16}", x)) for x in (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[order[(order.index((i, dict(rows)[i])) + 1) % len(order)][0]]["fingerprint"]))
            for x, y, name in ((own, new, "near_edited"), (own, then, "near_next")):
                assert got[i][name] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
            assert len(own) == len(set(own)) and (not a or own) and (len(a) < 40 or abs(len(own) / len(a) - 1 / sketch.FRACTION) < 0.25)
    assert got[4]["fingerprint"] == "" and got[5]["fingerprint"] != "" and got[5]["near_edited"] == 1.0
    assert sketch.edited_fingerprints(docs(spark, rows).limit(0), 4).count() == 0
    assert sketch.edited_fingerprints(docs(spark, ODD), 3).count() == sketch.edited_fingerprints(docs(spark, ODD)).count() == len(ODD)
    same = sketch.edited_fingerprints(docs(spark, [(i, rows[10 + i % 3][1]) for i in range(30)]), 5).collect()
    assert len({r["fingerprint"] for r in same}) == 3 and len({(r["fingerprint"], r["doc_id"] % 3) for r in same}) == 3


def test_sketches_unite(spark):
    rng = random.Random(6)
    a, b = words(rng, 600), words(rng, 600)
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, both string")
    for c in ("a", "b", "both"):
        df = sketch.with_sketch(df, c, f"s_{c}")
    r = df.select(sketch.containment(F.col("s_a"), F.col("s_both")).alias("c"), F.size(F.array_except("s_both", sketch.merge(F.col("s_a"), F.col("s_b")))).alias("d")).first()
    assert r["c"] == 1.0 and r["d"] <= 4  # only shingles across the seam are new


def brute_groups(rows):
    sets = {i: shingles(t, True) for i, t in rows if i is not None}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    common = Counter((a, b) for ids in inverted.values() for x, b in enumerate(ids) for a in ids[:x])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("crowd", [64, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(7)
    base = words(rng, 120).split()
    passage = words(rng, 30)
    rows = list({i: t for i, t in ODD if i is not None}.items())
    for i in range(100, 180):  # copies with more and more words changed: links, near misses and chains
        copy = [w if rng.random() > (i % 8) / 100 else f"x{rng.random()}" for w in base]
        rows.append((i, " ".join(copy)))
    rows += [(i, words(rng, 20) + " " + passage) for i in range(200, 240)] + [(i, "SAME text of all six words") for i in range(300, 340)]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    want = brute_groups(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_odd_rows(spark):
    df = docs(spark, ODD)
    assert neardup.near_duplicates(df).count() == len(ODD)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert {r["doc_id"] for r in neardup.one_of_each(df).collect()} >= {1, 2, 3, 4, 5, 7}


def test_repeated_rows_multiply_nothing(spark):
    rng = random.Random(12)
    base = words(rng, 80).split()
    rows = [(1, " ".join(base))] * 60 + [(2, " ".join([*base[:-1], "other"]))] * 60 + [(2, "another text of the same id " * 4)] * 3
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == 123 and {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1)}
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert neardup._confirmed(pairs, docs(spark, rows)).count() == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_fold(spark):
    df = docs(spark, [(i, "") for i in range(50)])
    got = df.select("doc_id", held_out(df["doc_id"]).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
