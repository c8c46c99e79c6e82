"""Numbering of rows against the plain window."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arboris.operators.number import numbered


def test_numbers_equal_those_of_a_window(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 7 > 2, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.col("id") * 7919 % 5000).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("y"),
    )
    w = Window.partitionBy("k").orderBy("y", "x")
    got = numbered(rows, ["k"], ["y", "x"], "n")
    want = rows.withColumn("n", F.row_number().over(w))
    assert got.columns == ["k", "x", "y", "n"]
    assert got.exceptAll(want).isEmpty() and got.count() == 5000
    assert numbered(rows.limit(0), ["k"], ["x"], "n").count() == 0
    same = numbered(spark.range(40).select(F.lit("k").alias("k"), F.lit(1).alias("x")), ["k"], ["x"], "n")
    assert sorted(r["n"] for r in same.collect()) == list(range(1, 41))


def test_rows_of_few_keys_are_not_shuffled_by_them(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).selectExpr("if(id % 3 = 0, null, cast(id % 3 as string)) as k", "id as v")
        got = numbered(df, ["k"], ["v"], "no")
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((str(r["k"]), r["v"], r["no"]) for r in got.collect()) == sorted((str(k), v, i + 1) for k, vs in {None: range(0, 2000, 3), "1": range(1, 2000, 3), "2": range(2, 2000, 3)}.items() for i, v in enumerate(vs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rows_without_a_key_are_dealt(spark):
    from arboris.operators.joins import left_dealt

    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(400).selectExpr("'p' as pair_id", "if(id % 4 = 0, cast(id as string), null) as k", "cast(id as string) as name")
        other = spark.range(0, 400, 8).selectExpr("'p' as pair_id", "cast(id as string) as k", "id as found")
        got = left_dealt(rows, other, ["pair_id", "k"], "name")
        assert sorted(map(str, got.select("pair_id", "k", "name", "found").collect())) == sorted(map(str, rows.join(other, ["pair_id", "k"], "left").select("pair_id", "k", "name", "found").collect()))
        tasks = got.where("k is null").rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        assert sum(tasks) == 300 and max(tasks) < 150
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
