"""The semantic contract: what each case of two small trees must give, all cases in one batch."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arboris.plans.engine import reconcile
from arboris.plans.localization import LocaleRule, Localization, Policy
from arboris.profiles import BUNDLES, Limits
from tests.trees import table

DITA = BUNDLES["dita-map-v1"]
CASES = dict(
    identical=("r#r[a#a,b#b]", "r#r[a#a,b#b]"),
    insert=("r#r[a#a,b#b]", "r#r[a#a,x#x,b#b]"),
    delete=("r#r[a#a,b#b]", "r#r[a#a]"),
    move=("r#r[p1#p1[a#a[a1#a1]],p2#p2]", "r#r[p1#p1,p2#p2[a#a[a1#a1]]]"),
    weak=("r#r[p1#p1[a:item{t:alpha}],p2#p2]", "r#r[p1#p1,p2#p2[b:item{t:beta}]]"),
    reorder=("r#r[a#a,b#b]", "r#r[b#b,a#a]"),
    update=("r#r[a#a{title:Hello}]", "r#r[a#a{title:Bonjour}]"),
    repeated=("r#r[s1:item{t:x},s2:item{t:x}]", "r#r[t1:item{t:x},t2:item{t:x}]"),
    duplicate=("r#r[a#dup,b#dup]", "r#r[c#dup]"),
    conflict=("r#r[a:topicref#shared]", "r#r[b:keydef#shared]"),
    mixed=("r#r[a#a,i1:item{t:x},i2:item{t:x}]", "r#r[a#a,j1:item{t:x},j2:item{t:x},extra#extra]"),
    cross=("r#r[p1#p1[i1:item{t:x},i2:item{t:x}],p2#p2]", "r#r[p1#p1,p2#p2[j1:item{t:x},j2:item{t:x}]]"),
    defect=("r#r[p1#p1[a#a[a1#a1{t:orig}]],p2#p2]", "r#r[p1#p1,p2#p2[a#a[a1#a1{t:changed}]]]"),
    probable=("r#r[a:item{t:x}[a1:leaf{t:q}]]", "r#r[b:item{t:x}]"),
    stale=("r#r[a#a{revision:3}]", "r#r[a#a{source-revision:2}]"),
)


def by_pair(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r["pair_id"]].append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


@pytest.fixture(scope="module")
def result(spark):
    return reconcile(table(spark, **CASES), DITA)


@pytest.fixture(scope="module")
def ops(result):
    return by_pair(result.operations, "type", "source_refs", "target_refs")


def kinds(ops, case):
    return sorted(t for t, _, _ in ops[case] if t != "MATCH")


def test_operations(ops):
    want = dict(
        identical=[], insert=["INSERT"], delete=["DELETE"], move=["MOVE"], weak=["DELETE", "INSERT"], reorder=["REORDER"], update=["UPDATE"],
        repeated=[], mixed=["INSERT"], cross=[], defect=["MOVE", "UPDATE"], stale=["UPDATE"],
    )
    assert {c: kinds(ops, c) for c in want} == want
    assert [t for t in ops["insert"] if t[0] == "INSERT"] == [("INSERT", [], ["x"])]
    assert [t for t in ops["mixed"] if t[0] == "INSERT"] == [("INSERT", [], ["extra"])]
    assert [t[1] for t in ops["reorder"] if t[0] == "REORDER"] == [["a", "b"]]


def test_matches_and_states(result):
    m = by_pair(result.matches, "s", "t", "state", "confidence")
    assert sorted(x[:2] for x in m["repeated"] if x[2] == "AMBIGUOUS") == [("s1", "t1"), ("s1", "t2"), ("s2", "t1"), ("s2", "t2")]
    assert ("a", "b", "REJECTED") in [x[:3] for x in m["conflict"]]
    assert not [x for x in m["duplicate"] if x[0] in "ab" and x[2] == "CONFIRMED" and x[3] == 1.0]
    assert ("a", "b", "CONFIRMED", 0.666667) in m["probable"]


def test_one_to_one_and_resolved(result):
    from arboris.operators import validate

    assert validate.match_violations(result.matches).count() == 0
    assert validate.operation_violations(result.operations).count() == 0
    assert validate.tree_violations(result.raw).count() == 0


def test_diagnostics(result):
    d = by_pair(result.diagnostics, "code")
    assert d["duplicate"].count("DUPLICATE_PERSISTENT_ID") == 1
    assert d["repeated"] == ["UNRESOLVED_ALIGNMENT_REGION"] and len(d["cross"]) == 2


def test_suppression(result):
    e = by_pair(result.effects.join(result.affected_refs(), ["pair_id", "effect_id"]), "category", "affected_refs", "independent_defect_check")
    assert e["move"] == [("DESCENDANT_PATH_CHANGED", ["a1"], "PASSED")]
    assert e["insert"] == [("DOWNSTREAM_POSITION_CHANGED", ["a", "b"], "NOT_APPLICABLE")]
    assert by_pair(result.retained, "node_ref")["defect"] == ["a1"]


def test_explanations(result):
    e = by_pair(result.explanations, "explanation_id", "n_roots")
    assert e["update"] == [("explanation-primary", 1)]
    assert len(e["repeated"]) == 2


def test_localization(result):
    loc = Localization(result, "fr-FR")
    s = by_pair(loc.issues, "status", "source_ref", "locale_ref", "recommendation_id")
    assert ("MISSING_IN_LOCALE", "b", None, "repair-1") in s["delete"]
    assert sorted(x[0] for x in s["repeated"]) == ["AMBIGUOUS_MATCH", "AMBIGUOUS_MATCH"]
    assert "PROBABLE_MATCH" in [x[0] for x in s["probable"]]
    assert [x[0] for x in s["stale"]] == ["SOURCE_UPDATED"]
    assert "WRONG_ORDER" in [x[0] for x in s["reorder"]] and "WRONG_PARENT" in [x[0] for x in s["move"]]
    move = [r for r in loc.recommendations.where("pair_id = 'move'").collect()]
    assert [(r["operation"], r["destination_parent_ref"], r["executable"]) for r in move] == [("MOVE_NODE", "p1", False)]


def test_exemption_needs_its_locale(spark):
    r = reconcile(table(spark, x=("r#r[a#a]", "r#r[a#a,note#note]")), DITA)
    policy = Policy("fr-FR", (LocaleRule("notes", "INSERT", ("topicref",)),))
    got = by_pair(Localization(r, "fr-FR", policy=policy).issues, "status")["x"]
    assert "EXEMPT_LOCALE_VARIATION" in got and "EXTRA_IN_LOCALE" not in got
    with pytest.raises(ValueError):
        Localization(r, "de-DE", policy=policy)


def test_presence_policies(spark):
    nodes = table(spark, x=CASES["repeated"], y=("r#r[i1:item{t:x},i2:item{t:x}]", "r#r[j1:item{t:x},j2:item{t:x},extra#extra]"))
    every = reconcile(nodes, DITA.with_(operation__presence_policy="EMIT_ALL"))
    got = by_pair(every.operations, "type", "evidence_codes")["x"]
    assert sorted(t for t, _ in got) == ["DELETE", "DELETE", "INSERT", "INSERT"]
    assert all("UNRESOLVED_CORRESPONDENCE_FORCED_BY_POLICY" in c for _, c in got)
    quiet = reconcile(nodes, DITA.with_(operation__presence_policy="SUPPRESS_UNRESOLVED_REGIONS"))
    assert by_pair(quiet.operations, "type")["y"] == []


def test_unordered_and_limits(spark):
    nodes = table(spark, x=CASES["reorder"], y=("r#r[a#a]", "r#r[a#a]"))
    r = reconcile(nodes, DITA.with_(alignment__ordered=False))
    assert "REORDER" not in by_pair(r.operations, "type")["x"]
    r = reconcile(nodes, DITA.with_(limits=Limits(max_node_count=4)))
    assert by_pair(r.diagnostics, "code")["x"] == ["RESOURCE_LIMIT_EXCEEDED"] and by_pair(r.operations, "type")["x"] == []
    assert by_pair(r.operations, "type")["y"] == ["MATCH"]


def test_order_of_rows_does_not_matter(spark, result):
    again = reconcile(table(spark, **dict(reversed(CASES.items()))).repartition(7), DITA)
    assert by_pair(again.fingerprint(), "fingerprint") == by_pair(result.fingerprint(), "fingerprint")


def test_broken_trees(spark):
    from arboris.operators.validate import tree_violations
    from tests.trees import SCHEMA
    from arboris.sources.edges import from_edges

    rows = [("p", "S", "r", "m", None, 0, {}, {}), ("p", "S", "q", "m", None, 0, {}, {}), ("p", "S", "a", "m", "b", 0, {}, {}), ("p", "S", "b", "m", "a", 0, {}, {}), ("p", "S", "c", "m", "zz", 0, {}, {}), ("p", "S", "d", "m", "c", 0, {}, {})]
    got = {(r["code"], r["node_ref"]) for r in tree_violations(from_edges(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {("MULTIPLE_ROOTS", "q"), ("CONTAINMENT_CYCLE", "a"), ("CONTAINMENT_CYCLE", "b"), ("DANGLING_PARENT_REF", "c")}


def test_generators(spark):
    from arboris.sources import generators as g

    wide = reconcile(g.wide(spark, 200, side="S").unionByName(g.wide(spark, 200, side="T")), DITA)
    assert wide.matches.where("state = 'CONFIRMED'").count() == 201 and wide.matches.count() <= 3 * 201
    alike = reconcile(g.repetitive(spark, 20, side="S").unionByName(g.repetitive(spark, 20, side="T")), DITA)
    assert alike.matches.where("state = 'AMBIGUOUS'").count() == 400 and alike.operations.count() == 0
    edits = by_pair(reconcile(g.high_edit(spark, 120), DITA).operations.groupBy("pair_id", "type").count(), "type", "count")["high-edit"]
    assert ("DELETE", 60) in edits and ("INSERT", 30) in edits


def test_quality_against_labels(spark, result):
    from arboris.plans import evaluate

    want = spark.createDataFrame([("insert", "op:insert:x", "INSERT"), ("delete", "op:delete:b", "DELETE")], "pair_id string, operation_id string, type string")
    pairs = spark.createDataFrame([("delete", "r", "r"), ("delete", "a", "a"), ("insert", "r", "r"), ("insert", "a", "a"), ("insert", "b", "b")], "pair_id string, s string, t string")
    part = reconcile(table(spark, insert=CASES["insert"], delete=CASES["delete"]), DITA)
    got = evaluate.quality(part, pairs, want)
    assert {(r["kind"], r["precision"], r["recall"]) for r in got.collect()} == {("MATCH", 1.0, 1.0), ("INSERT", 1.0, 1.0), ("DELETE", 1.0, 1.0)}
    assert evaluate.markdown(got).count("\n") == 5
    rates = by_pair(evaluate.ambiguity_rate(result), "ambiguity_rate")
    assert rates["repeated"] == [1.0] and rates["identical"] == [0.0]
    assert 0 < by_pair(evaluate.cascade_reduction(result), "cascade_reduction")["move"][0] < 1


MANY = "r#r[" + ",".join(f"{{}}{i}:item{{{{t:x}}}}" for i in range(20)) + "]"


def test_too_many_candidates_are_refused_openly(spark):
    from arboris.plans import jobs

    trees = table(spark, many=(MANY.format(*"s" * 20), MANY.format(*"t" * 20)), few=CASES["insert"])
    for limit, complete in ((399, False), (400, True)):
        r = reconcile(trees, DITA.with_(limits=Limits(max_candidates=limit)))
        assert {x["pair_id"]: x["complete"] for x in r.status.collect()} == {"many": complete, "few": True}
        matches, ops = by_pair(r.matches, "state"), by_pair(r.operations, "type")
        assert len(matches["few"]) == 3 and ops["few"].count("INSERT") == 1
        assert matches["many"].count("AMBIGUOUS") == (400 if complete else 0)
        codes = by_pair(r.diagnostics, "code", "message")
        assert (("RESOURCE_LIMIT_EXCEEDED", "candidates: 400") in codes["many"]) == (not complete) and not codes["few"]
        assert ("explanation-incomplete" in by_pair(r.explanations, "explanation_id")["many"]) == (not complete)
    text = "[" + ",".join("1" for _ in range(20)) + "]"
    requests = spark.createDataFrame([("j", "generic-json-v1", text, text), ("k", "generic-json-v1", "[1]", "[1]")], "pair_id string, profile_id string, source_content string, locale_content string")
    bundle = BUNDLES["generic-json-v1"].with_(limits=Limits(max_candidates=100))
    batch = jobs.compare(requests, "fr-FR", bundles={"generic-json-v1": bundle})
    assert {r["pair_id"]: (r["state"], r["error_code"]) for r in batch.jobs.collect()} == {"j": ("FAILED", "RESOURCE_LIMIT_EXCEEDED"), "k": ("COMPLETED", None)}


def test_candidates_are_counted_as_they_are_made(spark, result):
    from arboris.operators import match

    sure = match.authoritative(result.evidence, DITA.matching).where("state = 'CONFIRMED'")
    made = by_pair(match.candidates(result.evidence, sure, DITA.matching), "s", "t")
    counted = by_pair(match.candidate_counts(result.evidence, sure, DITA.matching), "n")
    assert all(len(made[p]) <= int(counted[p][0]) for p in made) and int(counted["repeated"][0]) == len(made["repeated"]) == 4


EDGES = "pair_id string, side string, node_ref string, parent_ref string"


def test_cycles_and_depths(spark):
    from arboris.operators import evidence, validate
    from arboris.storage import kept

    rows = [("deep", "S", f"n{i}", f"n{i - 1}" if i else None) for i in range(3000)]
    rows += [("ring", "S", "r", None), ("ring", "S", "a", "b"), ("ring", "S", "b", "a"), ("ring", "S", "c", "a"), ("ring", "S", "d", "r")]
    rows += [("lost", "S", "r", None), ("lost", "S", "x", "nowhere"), ("lost", "S", "y", "x"), ("lost", "S", "r2", None), ("lost", "S", "r2", None)]
    nodes = spark.createDataFrame(rows, EDGES)
    depth = {(r["pair_id"], r["node_ref"]): r["depth"] for r in evidence.depths(nodes, kept).collect()}
    assert all(depth["deep", f"n{i}"] == i + 1 for i in range(3000))
    assert {k[1]: v for k, v in depth.items() if k[0] == "ring"} == {"r": 1, "d": 2}
    found = {(r["pair_id"], r["code"], r["node_ref"]) for r in validate.tree_violations(nodes).collect()}
    assert found == {
        *(("ring", "CONTAINMENT_CYCLE", x) for x in "abc"), ("lost", "DANGLING_PARENT_REF", "x"), ("lost", "MULTIPLE_ROOTS", "r"), ("lost", "DUPLICATE_NODE_REF", "r2"),
    }
    first = {(r["pair_id"], r["code"], r["node_ref"], r["n"]) for r in validate.first_violations(validate.tree_violations(nodes)).collect()}
    assert first == {("ring", "CONTAINMENT_CYCLE", "a", 3), ("lost", "DANGLING_PARENT_REF", "x", 3)}
    tops = spark.createDataFrame([("deep", "S", "n10"), ("deep", "S", "n2990"), ("ring", "S", "a"), ("ring", "S", "r"), ("lost", "S", "x")], "pair_id string, side string, top string")
    below = {(r["pair_id"], r["top"], r["node_ref"]) for r in evidence.descendants(nodes, tops, kept).collect()}
    want = {("deep", t, f"n{i}") for t, a in (("n10", 11), ("n2990", 2991)) for i in range(a, 3000)}
    assert below == {*want, ("ring", "r", "d"), ("lost", "x", "y")}


def test_later_steps_join_nothing_that_matching_knew(spark):
    """Parents, places and equality of contents come with the matches; properties don't go through the joins."""
    r = reconcile(table(spark, j=("r#r[a#a[x#x,y#y],b#b]", "r#r[a#a[y#y],b#b[x#x]]")), DITA)
    assert not {"identity", "content", "structural", "loc"} & set(r.evidence.columns)
    ends = {(x["s"], x["t"]): (x["sp"], x["tp"], x["same"]) for x in r.graph.ends.collect()}
    parents = {(x["side"], x["node_ref"]): x["parent_ref"] for x in r.raw.collect()}
    assert ends and all((sp, tp) == (parents["S", s], parents["T", t]) for (s, t), (sp, tp, _) in ends.items())
    moved = [x for x in r.linked.collect() if not x["aligned"]]
    assert len(moved) == 1 and r.operations.where("type = 'MOVE'").count() == 1
    assert {x["same"] for x in r.positions.where("kind = 'ALIGNED'").collect()} <= {True, False}
    from arboris.operators import classify

    plan = classify.match_update(r.context)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_below_moved_leaves_nothing_is_looked_for(spark, monkeypatch):
    from arboris.operators import explain

    asked = []
    monkeypatch.setattr(explain, "descendants", lambda nodes, tops, stage: asked.append(tops.count()) or nodes.select("pair_id", "side", F.lit("").alias("top"), "node_ref").where("false"))
    for tree, n in ((("r#r[a#a[x#x],b#b]", "r#r[a#a,b#b[x#x]]"), 0), (("r#r[a#a[x#x[y#y]],b#b]", "r#r[a#a,b#b[x#x[y#y]]]"), 1)):
        r = reconcile(table(spark, j=tree), DITA)
        assert r.operations.where("type = 'MOVE'").count() == 1
        r.reach.count()
        assert asked.pop() == n
