"""Whitening against exact fractions and numpy."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from arboris.llm import whiten

SCHEMA = "vec_id long, embedding array<double>, n string, component string, deviation string"


def table(spark, rows):
    """Vectors with extra columns called as the results are."""
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def plain(rows, components=16):
    """n, S, components and every row's values in exact fractions as far as they go."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    cov = np.array([[float(sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in fit) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        away = np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x, s)])
        out[i] = (sum((n * a - b) ** 2 for a, b in zip(x, s)), away @ vectors / np.sqrt(values))
    return n, values / np.trace(cov), out


@pytest.mark.parametrize("d,k", [(5, 16), (20, 16), (3, 2)])
def test_equals_the_plain_version(spark, d, k):
    rng = random.Random(d)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(d)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(2000, None), (2001, [1.0] * (d - 1) + [None]), (2002, [float("nan")] * d), (2003, [float("inf")] * d), (2004, [1.0] * (d + 1)), (None, rows[1][1])]
    n, explained, want = plain([r for r in rows if r[0] != 2004], k)
    got = whiten.whiten(table(spark, rows), components=k).collect()
    assert len(got) == 501 * min(d, k) and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        c = r["component"] - 1
        deviation, white = want[r["vec_id"]]
        assert r["deviation"] == deviation and math.isclose(r["explained"], explained[c], rel_tol=1e-9) and r["identity_error"] < 1e-9
        if abs(white[c]) > 1e-6:
            assert math.isclose(abs(r["whitened"]), abs(white[c]), rel_tol=1e-6)
            signs.setdefault(c, set()).add(r["whitened"] * white[c] > 0)
    assert all(len(x) == 1 for x in signs.values())


def test_scatter_is_exact_for_large_entries():
    rng = random.Random(2)
    rows = [[rng.randrange(-(1 << b), 1 << b) for b in (5, 21, 44, 62)] for _ in range(5000)]
    own = whiten.Scatter(4)
    own.add(np.array(rows[:4500]))
    own.add(np.array(rows[4500:]))
    total = own.flush()
    assert all(total[i, j] == sum(r[i] * r[j] for r in rows) for i in range(4) for j in range(4))


def test_large_entries_through_spark(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 10.0**e for e in (0, 7, 12)]) for i in range(200)]
    n, explained, want = plain(rows)
    for r in whiten.whiten(table(spark, rows)).collect():
        assert r["deviation"] == want[r["vec_id"]][0] and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-6)
    assert whiten.whiten(table(spark, [(1, [1e300, 2.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])])).count() >= 3  # ends of a long


def test_nothing_to_whiten(spark):
    assert whiten.whiten(table(spark, [])).count() == 0
    assert whiten.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whiten.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whiten.whiten(table(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 9


def test_query(spark):
    from arboris.llm import queries

    got = queries.QUERIES["op12_exact_whitening"](spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType) for f in got.schema] == [
        ("vec_id", T.LongType()), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
        ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()),
    ]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    n, explained, want = plain(rows)
    out = got.collect()
    assert len(out) == 16 * len(want)
    for r in out:
        deviation, white = want[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-6)
        assert r["identity_error"] <= 1e-4 and math.isclose(abs(r["whitened"]), abs(white[r["component"] - 1]), rel_tol=1e-5, abs_tol=1e-7)
