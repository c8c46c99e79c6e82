"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

from arboris.llm import resample

SCHEMA = "doc_id long, text string, weight string, score string, key string"


def docs(spark, rows):
    """Documents with extra columns called as the results and the inner columns are."""
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in runs]


def plain(rows, target, percent=25, least=20, seed=7):
    s, t = [0] * 10000, [0] * 10000
    for count, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                count[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    out = []
    for i, text in rows:
        n, own = features(text)
        weight = math.floor(sum(gain[b] for b in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = percent * len(fit) // 100
    return sorted([(r[0], *r[2:], None) for r in out if r[1] < least] + [(r[0], *r[2:], place if place <= k else None) for place, r in enumerate(fit, 1)], key=str)


def words(rng, n, k=300):
    return " ".join(rng.choice(["W", "é", "x", "中"]) + str(rng.randrange(k)) for _ in range(n))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_the_plain_version(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(60))) for i in range(300)] + [(1000 + i, "the hot TEXT " * 10) for i in range(150)]
    rows += [(5001, None), (5002, ""), (5003, "!? \t"), (5004, "a"), (5005, words(rng, 20_000)), (None, words(rng, 25)), (5006, "_".join("abcdefghijklmnopqrstuvwxyz"))]
    target = [words(rng, 40, 30) for _ in range(20)] + ["hot text", None]
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    for percent, least in ((25, 20), (100, 1), (0, 5)):
        assert got(resample.resample(docs(spark, rows), bench, percent, least)) == plain(rows, target, percent, least)


def test_ties_repeats_and_empty_tables(spark):
    rng = random.Random(2)
    text = words(rng, 30)
    rows = [(7, text)] * 40 + [(None, text)] * 40 + [(i, text) for i in range(20)]
    bench = spark.createDataFrame([], "item_id long, text string")
    out = got(resample.resample(docs(spark, rows), bench, 50))
    assert out == plain(rows, [], 50) and sorted(r[4] for r in out if r[4]) == list(range(1, 51))
    assert resample.resample(docs(spark, []), bench).count() == 0


def test_query(spark):
    from arboris.llm import queries

    folder = "/root/testdata/sf0.001"
    df = queries.QUERIES["op11_importance_resample"](spark, folder)
    assert df.dtypes == [(n, "bigint") for n in ("doc_id", "n_features", "weight", "score", "rank")]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got(df) == plain(rows, target)
