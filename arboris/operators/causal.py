"""Causal links between operations, and circles in them by distributed strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arboris.storage import kept


def links(operations: DataFrame, reach: DataFrame, groups: DataFrame) -> DataFrame:
    """pair_id, cause, effect: a move and the operations on source nodes that it takes along."""
    moved = reach.where("type = 'MOVE'").join(groups, ["pair_id", "group_id"]).select("pair_id", F.col("operation_id").alias("cause"), "node_ref")
    on = operations.where("type in ('UPDATE', 'DELETE', 'MOVE')").select("pair_id", F.explode("source_refs").alias("node_ref"), F.col("operation_id").alias("effect"))
    return moved.join(on, ["pair_id", "node_ref"]).where("cause <> effect").select("pair_id", "cause", "effect").distinct()


def circles(edges: DataFrame, stage=kept) -> DataFrame:
    """pair_id, node and circle of each node that leads back to itself along ``edges`` (pair_id, a, b): the smallest node of
    its strongly connected component. No rows if there is no circle.

    Nodes without a way in or out are trimmed away, as many rounds as the longest way in that part is long. Then the
    smallest node that reaches it spreads to every node; a node that keeps its own name is the smallest of its component,
    and those of its name that lead back to it are the rest. They go, and what is left is looked at again. Null nodes take
    no part; repeated edges are one.
    """
    edges = stage(edges.where("a is not null and b is not null").select("pair_id", "a", "b").distinct())
    out = edges.where("a = b").select("pair_id", F.col("a").alias("node"), F.col("a").alias("circle"))
    edges = edges.where("a <> b")
    while True:
        n, before = edges.count(), -1
        while n not in (0, before):
            into, off = edges.select("pair_id", F.col("b").alias("a")).distinct(), edges.select("pair_id", F.col("a").alias("b")).distinct()
            edges = stage(edges.join(into, ["pair_id", "a"], "left_semi").join(off, ["pair_id", "b"], "left_semi").select("pair_id", "a", "b"))
            n, before = edges.count(), n
        if not n:
            return out.groupBy("pair_id", "node").agg(F.min("circle").alias("circle"))
        names = stage(edges.select("pair_id", F.col("a").alias("node")).union(edges.select("pair_id", "b")).distinct().withColumn("least", F.col("node")))
        changed = 1
        while changed:
            came = edges.join(names.select("pair_id", F.col("node").alias("a"), "least"), ["pair_id", "a"]).groupBy("pair_id", F.col("b").alias("node")).agg(F.min("least").alias("came"))
            names = stage(names.join(came, ["pair_id", "node"], "left").select("pair_id", "node", F.least("least", "came").alias("least"), (F.col("came") < F.col("least")).alias("fell")))
            changed = names.where("fell").count()
            names = names.drop("fell")
        ends = lambda e: names.select("pair_id", F.col("node").alias(e), F.col("least").alias(f"{e}_least"))
        alike = stage(edges.join(ends("a"), ["pair_id", "a"]).join(ends("b"), ["pair_id", "b"]).where("a_least = b_least").select("pair_id", "a", "b", F.col("a_least").alias("circle")))
        found = front = stage(names.where("node = least").select("pair_id", "node", F.col("least").alias("circle")))
        while not front.isEmpty():
            back = alike.join(front.select("pair_id", F.col("node").alias("b"), "circle"), ["pair_id", "b", "circle"]).select("pair_id", F.col("a").alias("node"), "circle").distinct()
            front = stage(back.join(found, ["pair_id", "node", "circle"], "left_anti"))
            found = stage(found.unionByName(front))
        many = found.groupBy("pair_id", "circle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(found.join(many, ["pair_id", "circle"], "left_semi").select("pair_id", "node", "circle"))
        gone = found.select("pair_id", "node")
        edges = stage(edges.join(gone.withColumnRenamed("node", "a"), ["pair_id", "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), ["pair_id", "b"], "left_anti").select("pair_id", "a", "b"))
