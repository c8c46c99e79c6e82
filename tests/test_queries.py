"""A selection of the queries against their SQL in DuckDB, and reports, decisions and streams on small data."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from arboris import detail_queries, queries  # noqa: F401
from arboris.plans import report
from arboris.plans.engine import reconcile
from arboris.plans.localization import Localization, price, record_decisions
from arboris.profiles import BUNDLES
from tests.trees import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["match_state_counts", "align_regions", "ops_move", "op_counts", "suppress_move_subtrees", "loc_summary", "dita_nodes_generated", "loc_issue_details", "report_csv_cells", "jobs_states", "decisions_recorded", "quality_labelled", "tree_first_violations"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    rel = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=key)


@pytest.fixture(scope="module")
def loc(spark):
    return Localization(reconcile(table(spark, j=("r#r[a#a,b#b,c#c]", "r#r[a#a,x#x]")), BUNDLES["dita-map-v1"]), "fr-FR")


def test_report_forms(spark, loc, tmp_path):
    rows = report.report_rows(loc)
    assert tuple(rows.columns) == report.COLUMNS
    got = {(r["localization_status"], r["is_suppressed"]) for r in rows.collect()}
    assert ("MISSING_IN_LOCALE", False) in got and ("SUPPRESSED_EFFECT", True) in got
    report.write_csv(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.startswith("job_id,result_id") and "0.9," in text
    report.write_jobs(rows, str(tmp_path / "jobs"))
    report.write_jobs(rows, str(tmp_path / "jobs"))
    assert spark.read.json(str(tmp_path / "jobs")).count() == rows.count()
    page = report.html_pages(rows).first()["html"]
    assert "<details>" in page and page.count("<tr data-status") == rows.count() and "<option>MISSING_IN_LOCALE</option>" in page and "high (1.00)" in page


def test_saved_reports_and_decisions(spark, loc, tmp_path):
    where = str(tmp_path / "saved")
    for _ in range(2):  # saving again replaces
        report.save(loc, where, redact=True)
    got = report.load(spark, where, "j")
    assert got["head"].select("job_id", "locale", "complete").first()[:] == ("j", "fr-FR", True)
    assert got["effect_groups"].join(got["group_members"], "group_id").count() == loc.result.effects.agg({"n_affected": "sum"}).first()[0]
    assert got["issues"].count() == loc.issues.count() and got["suppressed_effects"].count() == loc.result.effects.count()
    assert {r["status_symbol"] for r in got["issues"].where("status = 'MISSING_IN_LOCALE'").collect()} == {"-"}
    assert got["recommendations"].count() == loc.recommendations.count() > 0 and got["root_causes"].where("type = 'INSERT'").count() == 1
    assert report.load(spark, where, "other") == {}
    issue = loc.issues.orderBy("issue_id").first()["issue_id"]
    schema = "pair_id string, decision_id string, issue_id string, disposition string, replacement string, decided_at long"
    for n in (2, 1):
        d = spark.createDataFrame([("j", f"d{n}", issue, "ACCEPT", None, n), ("j", f"x{n}", "issue-99", "ACCEPT", None, n)], schema)
        report.append_decisions(record_decisions(d, loc.issues), str(tmp_path / "decisions"))
    assert [r["decision_id"] for r in report.decisions_of(spark, str(tmp_path / "decisions"), "j").collect()] == ["d1", "d2"]


def test_decisions_and_prices(spark, loc):
    issue = loc.issues.where("status = 'MISSING_IN_LOCALE'").orderBy("issue_id").first()["issue_id"]
    d = spark.createDataFrame(
        [("j", "d1", issue, "ACCEPT", None, 1), ("j", "d1", issue, "REJECT", None, 2), ("j", "d2", "issue-99", "ACCEPT", None, 3), ("j", "d3", issue, "OVERRIDE", None, 4), ("j", "d4", issue, "OVERRIDE", "CONFIRMED_MATCH", 5)],
        "pair_id string, decision_id string, issue_id string, disposition string, replacement string, decided_at long",
    )
    got = [(r["decision_id"], r["outcome"]) for r in record_decisions(d, loc.issues).orderBy("decided_at").collect()]
    assert got == [("d1", "RECORDED"), ("d1", "REPOSITORY_ERROR"), ("d2", "COMPARISON_REJECTED"), ("d3", "COMPARISON_REJECTED"), ("d4", "RECORDED")]
    rates = spark.createDataFrame([("missing", 0.5, "40"), ("confirmed", 0.1, "5")], "category string, hours double, price string")
    row = price(loc.summary, rates).first()
    assert (row["hours"], float(row["price"])) == (1.1, 85.0)


def test_stream_of_requests(spark, tmp_path):
    from arboris.streaming.requests import compare_stream

    src = tmp_path / "in"
    schema = "pair_id string, profile_id string, source_content string, locale_content string"
    spark.createDataFrame([("a", "generic-json-v1", "[1]", "[1, 2]")], schema).write.json(str(src))
    seen = []
    stream = spark.readStream.schema(schema).json(str(src))
    compare_stream(stream, "fr-FR", lambda batch, n: seen.extend((n, r["pair_id"], r["state"]) for r in batch.jobs.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(0, "a", "COMPLETED")]


def test_issue_rows_and_heads_make_no_other_part(spark):
    from arboris import storage

    loc = Localization(reconcile(table(spark, j=("r#r[a#a,b#b]", "r#r[a#a,x#x]")), BUNDLES["dita-map-v1"]), "fr-FR")
    before = len(storage._written)
    assert report.head_rows(loc).first()["complete"] and len(storage._written) == before  # nothing is compared
    assert loc.issues.count() > 0
    before = len(storage._written)
    assert {r["status_symbol"] for r in report.issue_rows(loc).collect()} == {"OK", "-", "+"}
    assert len(storage._written) == before and "effects" not in loc.result.__dict__
