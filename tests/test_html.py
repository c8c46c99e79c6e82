"""Whole HTML reports: their sections, pages in order, escapes."""

from __future__ import annotations

import html
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arboris import queries
from arboris.plans import report
from arboris.plans.engine import reconcile
from arboris.plans.localization import Localization
from arboris.profiles import BUNDLES
from tests.trees import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_the_query_makes_every_section(spark):
    got = {}
    for r in queries.QUERIES["html_report"](spark, DATA).collect():
        got.setdefault(r["job_id"], set()).add(r["section"])
    assert len(got) == 25 and all(s == {report.SUMMARY, report.ROOT_CAUSES, report.ISSUES, report.RECOMMENDATIONS} for s in got.values())


def test_pages_hold_every_row_in_order(spark, monkeypatch):
    # an ambiguous node is never missing too, so some numbers of issues are free
    pairs = {f"j<{i}": ("r#r[a#a,b#b{t:<x>},c#c,d:item{t:x},e:item{t:x},f#f]", "r#r[a#a,x#x,y#y,d:item{t:x},e:item{t:x}]") for i in range(3)}
    loc = Localization(reconcile(table(spark, **pairs, same=("r#r", "r#r")), BUNDLES["dita-map-v1"]), "fr-FR")
    want = {}
    for r in report.report_rows(loc).collect():
        want.setdefault(r["job_id"], []).append((r["is_suppressed"], int(r["result_id"].split("-")[1]), r["result_id"]))
    monkeypatch.setattr(report, "PAGE", 3)
    for pages in (report.html_pages(report.report_rows(loc)), report.html_report(loc).where(F.col("section") == report.ISSUES)):
        got, sizes, texts = {}, [], []
        for r in pages.orderBy("job_id", "part").collect():
            rows = re.findall(r"<tr data-status=[^>]*><td>([^<]*)</td><td>([^<]*)</td>", r["html"])
            assert {html.unescape(job) for job, _ in rows} == {r["job_id"]} and f"<h1>{html.escape(r['job_id'])}</h1>" in r["html"]
            got.setdefault(r["job_id"], []).extend(x for _, x in rows)
            sizes.append(len(rows))
            texts.append(r["html"])
        assert got == {j: [x[2] for x in sorted(rows)] for j, rows in want.items()} and max(sizes) == 3 and len(sizes) > 6
        assert any("needs review" in x for x in texts) and all("lang='en'" in x and x.count("scope='col'") > 50 for x in texts)
    n = {r["job_id"]: r["n"] for r in loc.recommendations.groupBy(F.col("pair_id").alias("job_id")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = report.html_report(loc).where(F.col("section") == report.RECOMMENDATIONS).collect()
    ids = sorted((r["job_id"], int(x)) for r in found for x in re.findall(r"<td>repair-(\d+)</td>", r["html"]))
    assert ids == sorted((j, i + 1) for j, k in n.items() for i in range(k)) and len(found) > len(n)
