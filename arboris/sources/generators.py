"""Synthetic trees of set shapes, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arboris.sources.edges import from_edges


def _tree(spark: SparkSession, n: int, pair: str, side: str, parent: Column, ident: Column | None, text: Column, kind: str) -> DataFrame:
    i = F.col("id")
    rows = spark.range(n).select(
        F.lit(pair).alias("pair_id"), F.lit(side).alias("side"), F.concat(F.lit("n"), i.cast("string")).alias("node_ref"), F.lit(kind).alias("node_type"), parent.alias("parent_ref"), i.alias("child_pos"),
        (F.create_map(F.lit("id"), ident) if ident is not None else F.create_map().cast("map<string,string>")).alias("identity"), F.create_map(F.lit("title"), text).alias("content"),
    )
    root = spark.range(1).select(
        F.lit(pair).alias("pair_id"), F.lit(side).alias("side"), F.lit("root").alias("node_ref"), F.lit("map").alias("node_type"), F.lit(None).cast("string").alias("parent_ref"), F.lit(0).cast("long").alias("child_pos"),
        F.create_map(F.lit("id"), F.lit("root")).alias("identity"), F.create_map().cast("map<string,string>").alias("content"),
    )
    return from_edges(root.unionByName(rows))


def wide(spark: SparkSession, n: int, pair: str = "wide", side: str = "S") -> DataFrame:
    """A root with ``n`` identified children."""
    i = F.col("id").cast("string")
    return _tree(spark, n, pair, side, F.lit("root"), F.concat(F.lit("id-"), i), F.concat(F.lit("t-"), i), "topicref")


def deep(spark: SparkSession, depth: int, pair: str = "deep", side: str = "S") -> DataFrame:
    """A chain."""
    i = F.col("id")
    parent = F.when(i == 0, "root").otherwise(F.concat(F.lit("n"), (i - 1).cast("string")))
    return _tree(spark, depth, pair, side, parent, F.concat(F.lit("id-"), i.cast("string")), F.concat(F.lit("t-"), i.cast("string")), "topicref")


def repetitive(spark: SparkSession, n: int, pair: str = "repetitive", side: str = "S") -> DataFrame:
    """A root with ``n`` children that nothing tells apart."""
    return _tree(spark, n, pair, side, F.lit("root"), None, F.lit("same"), "item")


def high_edit(spark: SparkSession, n: int, pair: str = "high-edit") -> DataFrame:
    """Both sides of a pair: every second child is gone, and a quarter as many are new."""
    s = wide(spark, n, pair, "S")
    t = wide(spark, n, pair, "T").where((F.col("node_ref") == "root") | (F.substring("node_ref", 2, 9).cast("int") % 2 == 0))
    i = F.col("id").cast("string")
    new = _tree(spark, n // 4, pair, "T", F.lit("root"), F.concat(F.lit("new-"), i), F.concat(F.lit("x-"), i), "topicref").where("node_ref <> 'root'")
    new = new.withColumn("node_ref", F.concat(F.lit("x"), "node_ref")).withColumn("child_pos", F.col("child_pos") + n)
    return s.unionByName(t).unionByName(new)
