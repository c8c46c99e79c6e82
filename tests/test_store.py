"""The store of jobs: whole versions or none."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from arboris.sources import store


def table(spark, rows):
    return spark.createDataFrame(rows, "job_id string, x long")


def read(spark, path, job):
    return {n: sorted(r["x"] for r in df.collect()) for n, df in store.load(spark, path, job).items()}


def test_a_version_replaces_a_job_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    both = table(spark, [("a", 1), ("a", 2), ("b", 3)])
    store.save({"t": both, "u": both}, both, path)
    assert read(spark, path, "a") == {"t": [1, 2], "u": [1, 2]} and read(spark, path, "c") == {}
    store.save({"t": table(spark, [("a", 9)])}, table(spark, [("a", 0), ("c", 0)]), path)
    assert read(spark, path, "a") == {"t": [9]} and read(spark, path, "c") == {"t": []}
    assert read(spark, path, "b") == {"t": [3], "u": [3]}


def test_a_failed_save_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = table(spark, [("a", 1)])
    store.save({"t": rows, "u": rows}, rows, path)
    bad = rows.withColumn("x", F.raise_error(F.lit("on purpose")).cast("long"))
    with pytest.raises(Exception, match="on purpose"):
        store.save({"t": table(spark, [("a", 7)]), "u": bad}, rows, path)
    assert read(spark, path, "a") == {"t": [1], "u": [1]}
    with pytest.raises(Exception, match="without an id"):
        store.save({"t": rows}, table(spark, [(None, 1)]), path)
    with pytest.raises(AnalysisException):
        store.load(spark, str(tmp_path / "nowhere"), "a")


def test_artifacts_have_safe_names(spark, tmp_path):
    path = str(tmp_path / "s")
    made = spark.createDataFrame([("a", "../rep ort.html", "text/html", "é"), ("a", "x", "text/plain", None)], "job_id string, name string, media_type string, content string")
    store.save({"artifacts": store.artifacts(made)}, made, path)
    got = {r["name"]: (r["size_bytes"], r["content"]) for r in store.load(spark, path, "a")["artifacts"].collect()}
    assert got == {"rep_ort.html": (2, "é"), "x": (0, "")} or got == {"_rep_ort.html": (2, "é"), "x": (0, "")}
    with pytest.raises(Exception, match="ARTIFACT_WRITE_FAILED"):
        store.save({"artifacts": store.artifacts(made.withColumn("name", F.lit("..")))}, made, path)
    assert store.load(spark, path, "a")["artifacts"].count() == 2


def test_two_writers_of_one_key_leave_one(spark, tmp_path):
    path = str(tmp_path / "log")
    store.append(table(spark, [("k", 1), ("l", 5)]), path)
    store.append(table(spark, [("k", 2)]), path)
    assert sorted(map(tuple, store.first_of(spark.read.parquet(path), "job_id").collect())) == [("k", 1), ("l", 5)]
