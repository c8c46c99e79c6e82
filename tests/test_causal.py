"""Circles against reachability; links from moves."""

from __future__ import annotations

import random

from arboris.operators.causal import circles
from arboris.plans.engine import reconcile
from arboris.profiles import BUNDLES
from tests.trees import table


def test_circles_equal_reachability(spark):
    rng = random.Random(3)
    rows, want = [("p0", None, "x"), ("p0", "x", None)], set()
    for p in range(25):
        n = rng.randrange(2, 12)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))}
        reach = {a: {b for x, b in edges if x == a} for a in range(n)}
        for _ in range(n):
            reach = {a: r | {y for b in r for y in reach[b]} for a, r in reach.items()}
        for a in range(n):
            if a in reach[a]:
                want.add((f"p{p}", f"{a:02}", f"{min(b for b in reach[a] if a in reach[b]):02}"))
        rows += [(f"p{p}", f"{a:02}", f"{b:02}") for a, b in edges] * 2
    df = spark.createDataFrame(rows, "pair_id string, a string, b string")
    assert {tuple(r) for r in circles(df).collect()} == want
    assert circles(df.limit(0)).count() == 0


def test_moves_cause_what_they_take_along(spark):
    r = reconcile(table(spark, defect=("r#r[p1#p1[a#a[a1#a1{t:orig}]],p2#p2]", "r#r[p1#p1,p2#p2[a#a[a1#a1{t:changed}]]]")), BUNDLES["dita-map-v1"])
    assert [tuple(x) for x in r.causal_links().collect()] == [("defect", "op:move:a->a", "op:update:a1->a1")]
    assert r.causal_circles().count() == 0
