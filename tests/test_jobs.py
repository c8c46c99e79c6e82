"""Jobs on trees that callers built, events and their redaction, whole HTML reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from arboris.functions.text import redacted_json
from arboris.plans import events, jobs, report
from arboris.profiles import BUNDLES
from tests.trees import table

DITA = BUNDLES["dita-map-v1"]


@pytest.fixture(scope="module")
def batch(spark):
    nodes = table(spark, ok=("r#r[a#a,b#b]", "r#r[a#a,x<y#x]"), bad=("r#r[a#a]", "r#r[a#a]"), same=("r#r", "r#r"))
    second = nodes.where("pair_id = 'bad' and side = 'T' and parent_ref is null").withColumn("node_ref", F.lit("second"))
    return jobs.compare_trees(nodes.unionByName(second), "fr-FR", DITA)


def test_broken_trees_are_rejected(batch):
    got = {r["pair_id"]: (r["state"], r["error_code"]) for r in batch.jobs.collect()}
    assert got == {"ok": ("COMPLETED", None), "bad": ("REJECTED", "MULTIPLE_ROOTS"), "same": ("COMPLETED", None)}
    assert batch.by_profile[DITA.bundle_id].result.nodes.where("pair_id = 'bad'").count() == 0


def test_no_trees(spark):
    assert jobs.compare_trees(table(spark, a=("r#r", "r#r")).where("false"), "fr-FR", DITA).jobs.collect() == []


def test_events_are_counts(spark, batch, tmp_path):
    rows = events.events(batch.jobs, batch.by_profile[DITA.bundle_id])
    seen = events.emit(rows, str(tmp_path / "log"))
    assert seen == {"stages": 8, "outcomes": 3}
    got = spark.read.json(str(tmp_path / "log"))
    ends = {r["job_id"]: json.loads(r["fields"]) for r in got.where("event = 'comparison.outcome'").collect()}
    assert ends["bad"]["outcome"] == "REJECTED" and ends["bad"]["technical_failure"] and ends["bad"]["match_count"] == 0
    assert ends["ok"]["completed_with_issues"] and ends["ok"]["source_node_count"] == 3 and ends["ok"]["match_count"] == 2
    assert not ends["same"]["completed_with_issues"] and not ends["same"]["technical_failure"]


@pytest.mark.parametrize(
    "text, masked",
    [
        (None, None),
        ("", "[REDACTED]"),
        ("[1]", "[REDACTED]"),
        ('{"token": ', "[REDACTED]"),
        ("{" + '"a":{' * 3000 + "}" * 3001, "[REDACTED]"),
        ('{"a":{"b":{"PassWord":{"x":1}}}}', '{"a":{"b":{"PassWord":"[REDACTED]"}}}'),
        ('{"list":[{"token":"t"}],"message":"m","é":null}', '{"list":[{"token":"t"}],"message":"[REDACTED]","é":null}'),
    ],
)
def test_redaction(spark, text, masked):
    assert spark.createDataFrame([(text,)], "x string").select(redacted_json(F.col("x"))).first()[0] == masked


def test_whole_html_report(batch):
    loc = batch.by_profile[DITA.bundle_id]
    pages = {(r["job_id"], r["section"]): r["html"] for r in report.html_report(loc).collect()}
    assert {k for k in pages if k[0] == "ok"} == {("ok", s) for s in (1, 2, 3, 4)}
    assert "<td>missing</td><td>1</td>" in pages["ok", 1] and "<td>locale</td><td>fr-FR</td>" in pages["ok", 1]
    assert "op:delete:" in pages["ok", 2] and "ADD_NODE" in pages["ok", 4]
    assert ("same", 1) in pages and ("same", 2) not in pages and ("same", 4) not in pages
