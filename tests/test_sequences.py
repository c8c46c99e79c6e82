"""Sequences: scripts against the full table, digests and orders of children against lists."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from arboris.functions import lcs
from arboris.functions.lcs import edit_script


def by_table(left, right):
    """The script by the lengths of all pairs of ends."""
    n, m = len(left), len(right)
    length = np.zeros((n + 1, m + 1), int)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            length[i, j] = length[i + 1, j + 1] + 1 if left[i] == right[j] else max(length[i + 1, j], length[i, j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i] == right[j]:
            out.append(("ALIGN", i, j))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and length[i + 1, j] >= length[i, j + 1]):
            out.append(("LEFT_ONLY", i, None))
            i += 1
        else:
            out.append(("RIGHT_ONLY", None, j))
            j += 1
    return out


@pytest.mark.parametrize("matches", [1 << 22, 7])
def test_scripts_equal_the_table(monkeypatch, matches):
    monkeypatch.setattr(lcs, "MATCHES", matches)
    rng = random.Random(matches)
    for k in range(1000):
        letters = "ab" if k % 3 == 0 else "abcdefgh" if k % 3 == 1 else [f"k{i}" for i in range(40)]
        left, right = ([rng.choice(letters) for _ in range(rng.randrange(30))] for _ in range(2))
        assert edit_script(left, right) == by_table(left, right)
    assert edit_script([], []) == [] and edit_script([None, 1], [None]) == [("ALIGN", 0, 0), ("LEFT_ONLY", 1, None)]


def test_a_million_items_in_bounded_memory():
    n = 1_000_000
    left = list(range(n))
    rng = random.Random(1)
    right = left[:]
    for _ in range(1000):  # some moves
        right.insert(rng.randrange(n), right.pop(rng.randrange(n)))
    tracemalloc.start()
    script = edit_script(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(script) <= n + 1000 and sum(k == "ALIGN" for k, _, _ in script) >= n - 1000 and peak < 1 << 30


def test_digests_stand_for_sequences(spark):
    from arboris.operators import evidence

    rng = random.Random(2)
    rows = []
    for p in range(300):
        for i in range(rng.randrange(6)):
            rows.append(("p", "S", f"n{p}.{i}", f"n{p}", rng.choice([i, 0, None]), rng.choice("xy")))
    df = spark.createDataFrame(rows, "pair_id string, side string, node_ref string, parent_ref string, child_pos long, node_type string")
    digest = {r["node_ref"]: r["digest"] for r in evidence.child_digests(df).collect()}
    text = {r["node_ref"]: r["types"] for r in evidence.child_types(df).collect()}
    assert digest.keys() == text.keys()
    assert len(set(digest.values())) == len(set(text.values())) == len({(d, text[k]) for k, d in digest.items()})


def test_falls_and_numbers_of_one_hot_key(spark):
    from arboris.operators.number import falls, numbered

    rng = random.Random(3)
    rows, want = [], {}
    for key in ["hot", *range(40)]:
        n = 3000 if key == "hot" else rng.randrange(1, 9)
        by = list(range(n)) if rng.random() < 0.5 or key == "hot" else rng.sample(range(n), n)
        want[str(key)] = by != sorted(by)
        rows += [(str(key), i, by[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, a long, b long").repartition(7)
    assert {r["k"]: r["f"] for r in falls(df, ["k"], ["a"], ["b"], "f").collect()} == want
    at = next(i for i, r in enumerate(rows) if r[:2] == ("hot", 1500))
    rows[at], rows[at + 1] = ("hot", 1500, 1501), ("hot", 1501, 1500)
    df = spark.createDataFrame(rows, "k string, a long, b long")
    assert {r["k"]: r["f"] for r in falls(df, ["k"], ["a"], ["b"], "f").collect()} == {**want, "hot": True}
    assert all(r["n"] == r["a"] + 1 for r in numbered(df.repartition(5), ["k"], ["a"], "n").collect())
    assert falls(df.limit(0), ["k"], ["a"], ["b"], "f").count() == numbered(df.limit(0), ["k"], ["a"], "n").count() == 0
    assert sorted(r["n"] for r in numbered(df, [], ["k", "a"], "n").collect()) == list(range(1, len(rows) + 1))
