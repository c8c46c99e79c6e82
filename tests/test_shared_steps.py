"""Steps that most queries share: what they read of a node, and which nodes they look up."""

from __future__ import annotations

import random

from arboris.operators import evidence
from arboris.operators.normalize import normalize
from arboris.plans.engine import reconcile
from arboris.profiles import BUNDLES
from arboris.sources.edges import from_edges
from arboris.storage import kept

DITA = BUNDLES["dita-map-v1"]
SCHEMA = "pair_id string, side string, node_ref string, node_type string, parent_ref string, child_pos long, identity map<string,string>, content map<string,string>"


def forest(rng, pair):
    rows = []
    for side in "ST":
        refs = []
        for i in range(rng.randrange(1, 25)):
            parent = rng.choice(refs) if refs and rng.random() > 0.15 else None
            pid = rng.choice([None, f"i{i}", f"i{i}", f"i{rng.randrange(25)}"])
            rows.append((pair, side, f"{side.lower()}{i}", rng.choice("xy"), parent, rng.randrange(9), {"id": pid} if pid else {}, {"t": rng.choice("pq")}))
            refs.append(f"{side.lower()}{i}")
    return rows


def test_properties_are_read_once(spark):
    nodes = kept(from_edges(spark.createDataFrame(forest(random.Random(1), "1"), SCHEMA)))
    staged = []
    rows = evidence.extract(normalize(nodes, DITA.normalization), lambda df: staged.append(df) or kept(df))
    assert len(staged) == 1 and not set(evidence.BAGS) & set(rows.columns)
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()
    plain = evidence.extract(normalize(nodes, DITA.normalization)).select(*rows.columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, plain.collect()))


def test_ids_that_stand_more_than_once_are_counted(spark):
    rows = [("1", "S", f"n{i}", "x", None, i, {"id": pid} if pid else {}, {}) for i, pid in enumerate(["a", "a", "b", None, "a", None])]
    rows.append(("1", "T", "m", "x", None, 0, {"id": "a"}, {}))
    out = evidence.extract(from_edges(spark.createDataFrame(rows, SCHEMA)))
    assert {r["node_ref"]: r["id_dup_count"] for r in out.collect()} == {"n0": 3, "n1": 3, "n2": 1, "n3": None, "n4": 3, "n5": None, "m": 1}


def test_positions_of_forests(spark):
    rng = random.Random(7)
    rows = [r for pair in range(12) for r in forest(rng, str(pair))]
    r = reconcile(kept(from_edges(spark.createDataFrame(rows, SCHEMA))), DITA)
    by = {(x["pair_id"], x["node_ref"]): x["parent_ref"] for x in r.nodes.collect()}
    ends = {(x["pair_id"], x["s"], x["t"]) for x in r.sure.where("state = 'CONFIRMED'").collect()}
    tops = [k for k, parent in by.items() if parent is None]
    pairs = ends | {(p, s, t) for p, s in tops for q, t in tops if p == q and s[0] == "s" and t[0] == "t"}
    aligned = {(p, by[p, s], by[p, t], s, t) for p, s, t in ends if (p, by[p, s], by[p, t]) in pairs}
    want = set(aligned)
    for p, sp, tp in pairs:
        for (q, ref), parent in by.items():
            if q == p and parent in (sp, tp):
                # below a root a node is looked for in each pair of roots, elsewhere once
                in_region = {x[3 if ref[0] == "s" else 4] for x in aligned if x[0] == p and (by[p, parent] is not None or x[1:3] == (sp, tp))}
                if ref not in in_region:
                    want.add((p, sp, tp, ref, None) if ref[0] == "s" else (p, sp, tp, None, ref))
    got = [(x["pair_id"], x["sp"], x["tp"], x["s"], x["t"]) for x in r.positions.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(x["pair_id"], x["sp"], x["tp"]) for x in r.regions.collect()} == pairs
