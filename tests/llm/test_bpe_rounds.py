"""Merge rounds against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest

from arboris.llm import bpe_rounds

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string"
LONG = "word " * 70_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a<|endoftext|>  b<|endoftext|>"), (6, "x" * 5000), (7, LONG), (7, LONG), (None, "zz yy"), (11, "naïve 中文 😀 ٣")]


@pytest.fixture(scope="module")
def path():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def codec(path):
    return bpe_rounds.Codec(bpe_rounds.Vocabulary.read(path))


def ids_of(codec, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]


def test_equals_the_library(codec, library):
    rng = random.Random(5)
    letters = "aAbstTheré ß中文😀\n\t  1239.,!'#\x1c\x85\xa0₏՘"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "<|endoftext", "don't  we'll\r\n\r\n  x", "the " * 500, "aaaa" * 999, "ab" * 1501]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(codec, texts) == want
    assert [codec.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    for _ in range(300):
        some = [rng.randrange(50_300) for _ in range(rng.randrange(20))]
        assert codec.decode(some) == library.decode(some, skip_special_tokens=False)


def test_long_words_in_order_of_ranks(codec, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice(k) for _ in range(n)) for k, n in (("ab", 700), ("etaoinshrdlu", 4000), ("中文字我们的", 900), ("a", 3001), ("=-", 5000))]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(codec, texts) == want
    raw = ["".join(rng.choice("etaoin") for _ in range(200)).encode() for _ in range(50)]
    sym, size = codec.vocabulary.first[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(x) for x in raw])
    a, b = codec.vocabulary._by_word(sym.copy(), size), codec.vocabulary._by_rank(sym.copy(), size)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_classes_of_all_code_points(codec, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    cut = library.pre_tokenizer.pre_tokenize_str
    for i in range(0, len(points), 20_000):
        text = "".join(f"\na{chr(c)}\n1{chr(c)}\n!{chr(c)}" for c in points[i : i + 20_000])
        lengths = [b - a for _, (a, b) in cut(text)]
        assert [len(p) for some in codec.words(text) for p in some] == lengths


def test_small_vocabularies_and_refusals(library, path):
    with open(path) as f:
        spec = json.load(f)
    none = bpe_rounds.Codec(bpe_rounds.Vocabulary({**spec, "added_tokens": [], "model": {**spec["model"], "merges": []}}))
    assert len(none.encode(["abc"])[0]) == 12 and none.encode([None]) == [b""]
    for bad in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": {**spec["model"], "byte_fallback": True}}, {"model": {**spec["model"], "merges": spec["model"]["merges"][::-1]}}):
        with pytest.raises(ValueError):
            bpe_rounds.Vocabulary({**spec, **bad})


def test_columns(spark, path, library):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in ODD], SCHEMA)
    both = bpe_rounds.decode(bpe_rounds.encode(df, path), path).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids for r in both)
    got = bpe_rounds.round_trip(df, path).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    for r in got:
        text = dict(ODD)[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_rounds.round_trip(df.limit(0), path).count() == 0


def test_query(spark, library):
    from arboris.llm import queries

    got = queries.QUERIES["op13_merge_rounds"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    rows = {r["doc_id"]: r for r in got.collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d, e in zip(docs, library.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False)):
        r = rows[d["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
