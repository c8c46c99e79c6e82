"""Families of long texts around the threshold: everything that two sets share is counted exactly, in blocks."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from arboris.llm import neardup
from arboris.llm.neardup import forest, in_common, links_across


def test_what_sets_have_in_common():
    rng = np.random.default_rng(4)
    for m, k in ((1, 9), (7, 30), (150, 400), (400, 60)):
        core = rng.integers(0, 2**63, k).astype(np.uint64)
        sets = [np.unique(np.concatenate((rng.choice(core, rng.integers(0, k)), rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)))) for _ in range(m)]
        got = in_common(sets)
        assert all(got[i, j] == got[j, i] == len(np.intersect1d(sets[i], sets[j])) for i, j in combinations(range(m), 2))
    assert in_common([]).shape == (0, 0) and in_common([np.zeros(0, np.uint64)] * 2)[0, 1] == 0


def test_a_forest_joins_what_links_join():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(1, 30)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(60))]
        left, right = (np.array([x[k] for x in links], np.int64) for k in (0, 1))

        def parts(some):
            of = list(range(n))
            for a, b in some:
                of = [of[b] if x == of[a] else x for x in of]
            return {frozenset(i for i in range(n) if of[i] == x) for x in of}

        kept = forest(left, right, n)
        assert parts([links[k] for k in kept]) == parts(links) and len(kept) < n


def family(rng, n, core, own):
    """Texts that share a core of ``core`` words; of each, one run of ``own`` words is its own."""
    base = [f"c{rng.randrange(10**6)}" for _ in range(core)]
    out = []
    for _ in range(n):
        at = rng.randrange(core)
        k = own + rng.randrange(-own // 20, own // 20 + 1)
        out.append(" ".join(base[:at] + [f"o{rng.randrange(10**9)}" for _ in range(k)] + base[at:]))
    return out


def test_a_family_below_the_threshold_sends_no_pairs(spark, monkeypatch):
    """Similarities of 0.72 to 0.78, so that some are links: equal to brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 100)
    rng = random.Random(5)
    texts = family(rng, 260, 1200, 200)
    sets = neardup.shingle_sets(texts)
    links, of = 0, list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if neardup.similar_enough(both, len(sets[i]), len(sets[j])):
            links += 1
            low, high = sorted((of[i], of[j]))
            of = [low if x == high else x for x in of]
    assert 0 < links < 260 * 259 // 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), of[i]) for i in range(len(texts))}


def test_blocks_of_long_texts_in_bounded_time():
    rng = random.Random(6)
    texts = family(rng, 700, 2200, 800)  # similarities about 0.58
    sets = neardup.shingle_sets(texts)
    i, j = links_across(np.arange(700), neardup.signatures(sets), sets, 0)
    assert len(i) == len(j) == 0
    near = sets + [s[: len(s) * 9 // 10] for s in sets[:5]]
    i, j = links_across(np.arange(705), neardup.signatures(near), near, 700)
    assert sorted(zip(i.tolist(), j.tolist())) == [(k, 700 + k) for k in range(5)]
