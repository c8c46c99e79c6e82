"""Findings without numbers, and what is staged for counts, issues and effects."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from arboris.operators import explain
from arboris.plans import localization
from arboris.plans.engine import reconcile
from arboris.plans.localization import LocaleRule, Localization, Policy
from arboris.profiles import BUNDLES
from arboris.sources.edges import from_edges
from arboris.storage import kept
from tests.test_shared_steps import SCHEMA, forest

DITA = BUNDLES["dita-map-v1"]


def forests(spark, seed, n=12):
    rng = random.Random(seed)
    return kept(from_edges(spark.createDataFrame([r for pair in range(n) for r in forest(rng, str(pair))], SCHEMA)))


def test_counts_number_nothing(spark, monkeypatch):
    loc = Localization(reconcile(forests(spark, 3), DITA), "fr-FR", policy=Policy("fr-FR", (LocaleRule("x", "INSERT", ("x",)),)))
    loc.result.diagnostics  # noqa: B018  numbered before
    ordered = []
    monkeypatch.setattr(localization, "numbered", lambda *a: ordered.append(a[-1]) or a[0])
    shown = ["pair_id", "status", "severity", "action", "source_ref", "locale_ref", "exemption"]
    found = sorted(map(str, loc.findings.select(*shown).collect()))
    loc.status_counts.count(), loc.summary.count()
    assert not ordered
    monkeypatch.undo()
    assert found == sorted(map(str, loc.issues.select(*shown).collect()))
    assert loc.findings.where("repair").count() == loc.recommendations.count() > 0
    assert loc.issues.where("status = 'EXEMPT_LOCALE_VARIATION'").count() > 0
    # numbers of repairs have no gaps, and follow those of issues
    rows = loc.issues.where("recommendation_id is not null").select("pair_id", F.col("issue_no"), F.substring("recommendation_id", 8, 9).cast("long").alias("n")).orderBy("pair_id", "issue_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r["pair_id"], []).append(r["n"])
    assert all(ns == list(range(1, len(ns) + 1)) for ns in by.values())


def test_stages_after_those_counted_are_not_made(spark):
    r = reconcile(forests(spark, 4, 3), DITA)
    got = r.stage_counts("MATCHING", "ALIGNMENT", "CLASSIFICATION")
    assert "effects" not in r.__dict__ and "_reached" not in r.__dict__
    assert sorted(map(str, got.collect())) == sorted(map(str, r.metrics.where("stage <> 'SUPPRESSION'").select(*got.columns).collect()))


def test_effects_of_forests(spark):
    r = reconcile(forests(spark, 5), DITA)
    lined = [x for x in r.positions.collect() if x["kind"] == "ALIGNED"]
    kids = {}
    for x in r.raw.where("side = 'S'").collect():
        kids.setdefault((x["pair_id"], x["parent_ref"]), []).append(x["node_ref"])
    want = {}
    for o in r.operations.collect():
        p, refs = o["pair_id"], set()
        if o["type"] in ("INSERT", "DELETE"):
            end = "t" if o["type"] == "INSERT" else "s"
            ref = o["target_refs" if end == "t" else "source_refs"][0]
            at = {(x["sp"], x["tp"]) for x in r_positions(r) if x["pair_id"] == p and x[end] == ref}
            refs = {x["t"] for x in lined if x["pair_id"] == p and (x["sp"], x["tp"]) in at}
        elif o["type"] == "MOVE":
            todo = list(kids.get((p, o["source_refs"][0]), []))
            while todo:
                refs.add(todo[-1])
                todo.extend(kids.get((p, todo.pop()), []))
        elif o["type"] == "REORDER":
            sp = o["operation_id"].removeprefix("op:reorder:")
            own = {x["operation_id"]: x for x in r_siblings(r) if x["pair_id"] == p}[o["operation_id"]]
            under = {x["s"] for x in r_siblings(r) if x["pair_id"] == p and x["operation_id"] == o["operation_id"]}
            refs = {x["t"] for x in lined if x["pair_id"] == p and (x["sp"] == own["sp"] == sp or x["sp"] in under)}
        if refs and o["confidence"] >= (0.7 if o["type"] == "MOVE" else 0.6):
            want[p, o["operation_id"]] = refs
    got = {(e["pair_id"], e["root_operation_id"]): (e["n_affected"], e["first_ref"], e["last_ref"]) for e in r.effects.collect()}
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()} and len({k[1].split(":")[1] for k in got}) >= 3
    # members are read on request and fit the sizes; digests are plain sums of hashes
    digest = F.sum(F.xxhash64("node_ref").cast("decimal(20,0)")).cast("decimal(28,0)").alias("digest")
    rows = r.reach_groups.groupBy("pair_id", "group_id").agg(F.count(F.lit(1)).alias("n"), F.min("node_ref").alias("low"), F.max("node_ref").alias("high"), digest)
    sizes = explain.sizes(r.positions, r._reached[1]).join(r.reach.select("pair_id", "group_id").distinct(), ["pair_id", "group_id"], "left_semi")
    assert sorted(map(str, rows.collect())) == sorted(map(str, sizes.select(*rows.columns).collect()))


def r_positions(r, cache={}):
    return cache.setdefault(id(r), r.positions.collect())


def r_siblings(r, cache={}):
    return cache.setdefault(id(r), r.siblings.collect())
