"""Lives of jobs: any order of events, repeats, time-outs, a restart from the checkpoint."""

from __future__ import annotations

import datetime as dt

import pytest

from arboris.streaming.lifecycle import events_of, lifecycle, refused, run_jobs, stateful

SCHEMA = "job_id string, state string, code string, at timestamp"
ALL = ("CREATED", "VALIDATING_INPUTS", "RUNNING")


def at(minutes: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture
def life(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def step(rows) -> list[tuple]:
        """Append events, let a query that starts from the checkpoint take them in, and return all steps so far."""
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        stateful(lifecycle(stream, "1 minute", patience_s=600, memory_s=3600), out, cp).awaitTermination()
        return sorted((r["job_id"], r["n"] or 0, r["from_state"] or "", r["to_state"], r["code"] or "", r["accepted"], r["n_events"]) for r in spark.read.parquet(out).collect())

    return step


def test_one_outcome_whatever_comes(spark, life):
    whole = [("a", s, None, at(i)) for i, s in enumerate((*ALL, "COMPLETED"))]
    early = [("b", "COMPLETED", None, at(3)), ("b", "CREATED", None, at(0))]  # its middle comes later
    first = life([*whole, *early, ("c", "CREATED", None, at(0)), ("c", "VALIDATING_INPUTS", None, at(1)), ("c", "REJECTED", "INVALID_INPUT", at(2)), ("c", "RUNNING", None, at(3))])
    assert [r[:5] for r in first if r[5] and r[0] == "a"] == [("a", 1, "", "CREATED", ""), ("a", 2, "CREATED", "VALIDATING_INPUTS", ""), ("a", 3, "VALIDATING_INPUTS", "RUNNING", ""), ("a", 4, "RUNNING", "COMPLETED", "")]
    assert [r[3] for r in first if r[0] == "b"] == ["CREATED"]
    assert [(r[3], r[4]) for r in first if r[0] == "c" and r[5]][-1] == ("REJECTED", "INVALID_INPUT") and ("c", 0, "REJECTED", "RUNNING", "", False, 1) in first
    # the batch runs again, and the other job's middle arrives: from the checkpoint on, nothing happens twice
    second = life([*whole, *whole, ("a", "FAILED", "X", at(4)), ("b", "RUNNING", None, at(2.5)), ("b", "VALIDATING_INPUTS", None, at(2.5))])
    ends = [(r[0], r[3]) for r in second if r[5] and r[3] in ("COMPLETED", "FAILED", "REJECTED")]
    assert sorted(ends) == [("a", "COMPLETED"), ("b", "COMPLETED"), ("c", "REJECTED")]
    assert ("a", 0, "COMPLETED", "COMPLETED", "", False, 2) in second and ("a", 0, "COMPLETED", "FAILED", "X", False, 1) in second
    assert set(first) <= set(second)


def test_patience_ends(life):
    life([("t", s, None, at(i)) for i, s in enumerate(ALL)] + [("only", "RUNNING", None, at(0))])
    got = life([("late", "CREATED", None, at(20)), ("late", "VALIDATING_INPUTS", None, at(20))])
    assert ("t", 4, "RUNNING", "FAILED", "JOB_TIMED_OUT", True, 0) in got
    assert not [r for r in got if r[0] == "only"]  # an event that nothing led to is forgotten
    got = life([("t", "COMPLETED", None, at(21))])
    assert ("t", 0, "FAILED", "COMPLETED", "", False, 1) in got


def test_unfit_events(spark):
    rows = spark.createDataFrame([(None, "CREATED", None, at(0)), ("a", "SLEEPING", None, at(0)), ("a", None, None, at(0)), ("a", "CREATED", None, None), ("a", "CREATED", None, at(0))], SCHEMA)
    assert refused(rows).count() == 4


def test_jobs_of_a_stream(spark, tmp_path):
    from arboris.plans import report

    src, saved, events = (str(tmp_path / n) for n in ("in", "saved", "events"))
    schema = "pair_id string, profile_id string, source_content string, locale_content string"
    spark.createDataFrame([("a", "generic-json-v1", "[1]", "[1, 2]"), ("b", "generic-json-v1", "[1", "[1]"), ("c", "none", "", "")], schema).write.json(src)
    for cp in ("cp", "again"):  # a lost checkpoint: everything runs again
        run_jobs(spark.readStream.schema(schema).json(src), "fr-FR", saved, events, str(tmp_path / cp)).awaitTermination()
    stateful(lifecycle(spark.readStream.schema(SCHEMA).parquet(events)), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    steps = spark.read.parquet(str(tmp_path / "out")).where("accepted")
    ends = {(r["job_id"], r["to_state"], r["code"]) for r in steps.where("to_state in ('COMPLETED', 'FAILED', 'REJECTED')").collect()}
    assert ends == {("a", "COMPLETED", None), ("b", "REJECTED", "INVALID_INPUT"), ("c", "REJECTED", "UNSUPPORTED_CONTRACT")}
    assert steps.count() == 4 + 3 + 3
    assert report.load(spark, saved, "a")["issues"].count() > 0


def test_events_of_no_jobs(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "pair_id string, state string, error_code string")
    assert events_of(none, F.lit("2024-01-01")).collect() == []
