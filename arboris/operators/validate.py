"""Invariants of trees and results, as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arboris.operators.evidence import ancestry, depths
from arboris.profiles import Limits
from arboris.storage import kept


def tree_violations(nodes: DataFrame, stage=kept) -> DataFrame:
    """pair_id, side, code, node_ref of what breaks the rules of a tree."""
    key = ["pair_id", "side"]
    refs = nodes.select(*key, "node_ref")

    def rows(df: DataFrame, code: str, ref: Column) -> DataFrame:
        return df.select(*key, F.lit(code).alias("code"), ref.alias("node_ref"))

    parents = refs.withColumnRenamed("node_ref", "parent_ref")
    out = [
        rows(nodes.where("parent_ref is not null").join(parents, [*key, "parent_ref"], "left_anti"), "DANGLING_PARENT_REF", F.col("node_ref")),
        rows(refs.groupBy(*key, "node_ref").count().where("count > 1"), "DUPLICATE_NODE_REF", F.col("node_ref")),
        rows(nodes.where("parent_ref is null").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("node_ref").alias("r")).where("n > 1"), "MULTIPLE_ROOTS", F.col("r")),
        rows(nodes.groupBy(*key).agg(F.count_if(F.col("parent_ref").isNull()).alias("n"), F.min("node_ref").alias("r")).where("n = 0"), "MISSING_ROOT", F.col("r")),
    ]
    # below a dangling node no root is reached either, but that is no cycle
    out.append(rows(ancestry(nodes, stage).where("ends = 'CYCLE'"), "CONTAINMENT_CYCLE", F.col("node_ref")))
    if "child_refs" in nodes.columns:
        listed = nodes.select(*key, F.col("node_ref").alias("parent"), F.explode("child_refs").alias("node_ref"))
        own = nodes.select(*key, "node_ref", F.col("parent_ref").alias("parent"))
        out.append(rows(listed.join(refs, [*key, "node_ref"], "left_anti"), "DANGLING_CHILD_REF", F.col("node_ref")))
        out.append(rows(listed.join(refs, [*key, "node_ref"], "left_semi").join(own, [*key, "node_ref", "parent"], "left_anti"), "PARENT_CHILD_DISAGREEMENT", F.col("node_ref")))
        out.append(rows(own.where("parent is not null").join(listed, [*key, "node_ref", "parent"], "left_anti"), "MISSING_FROM_PARENT_CHILDREN", F.col("node_ref")))
    return reduce(DataFrame.unionByName, out)


#: Codes in the order in which they are reported for a tree.
CODES = (
    "CONTAINMENT_CYCLE", "DANGLING_CHILD_REF", "PARENT_CHILD_DISAGREEMENT", "DANGLING_PARENT_REF", "MISSING_FROM_PARENT_CHILDREN", "MULTIPLE_ROOTS", "MISSING_ROOT", "DUPLICATE_NODE_REF",
)


def first_violations(violations: DataFrame) -> DataFrame:
    """pair_id, side, code, node_ref of each tree's first violation (by code, then node), and how many there are."""
    rank = F.array_position(F.array(*map(F.lit, CODES)), F.col("code"))
    return violations.groupBy("pair_id", "side").agg(F.min(F.struct(rank.alias("rank"), "node_ref", "code")).alias("x"), F.count(F.lit(1)).alias("n")).select("pair_id", "side", "x.code", "x.node_ref", "n")


def match_violations(matches: DataFrame) -> DataFrame:
    """pair_id, code, ref: ends of more than one confirmed match; states without what they need."""
    sure = matches.where("state = 'CONFIRMED'")
    out = [sure.groupBy("pair_id", F.col(e).alias("ref")).count().where("count > 1").select("pair_id", F.lit(f"NOT_ONE_TO_ONE_{e.upper()}").alias("code"), "ref") for e in "st"]
    out.append(matches.where("state <> 'REJECTED' and size(evidence) = 0").select("pair_id", F.lit("NO_EVIDENCE").alias("code"), F.col("match_id").alias("ref")))
    out.append(sure.where("size(violations) > 0").select("pair_id", F.lit("CONFIRMED_WITH_VIOLATION").alias("code"), F.col("match_id").alias("ref")))
    return reduce(DataFrame.unionByName, out)


def operation_violations(operations: DataFrame) -> DataFrame:
    rule = (
        F.when((F.col("type") == "REORDER") & (F.size("source_refs") < 2), "REORDER_OF_ONE")
        .when((F.col("type") == "MOVE") & F.col("from_parent").eqNullSafe(F.col("to_parent")), "MOVE_TO_SAME_PARENT")
        .when(F.col("type").isin("MATCH", "UPDATE", "MOVE") & (F.size("match_ids") == 0), "NO_MATCH_ID")
    )
    return operations.select("pair_id", rule.alias("code"), F.col("operation_id").alias("ref")).where("code is not null")


def over_limits(nodes: DataFrame, limits: Limits, stage=kept) -> DataFrame:
    """pair_id and message of pairs with too many nodes or too deep a tree."""
    none = nodes.select("pair_id", F.lit("").alias("message")).where("false")
    out = [none]
    if limits.max_node_count is not None:
        n = nodes.groupBy("pair_id").count().where(F.col("count") > limits.max_node_count)
        out.append(n.select("pair_id", F.concat(F.lit("nodes: "), F.col("count").cast("string")).alias("message")))
    if limits.max_tree_depth is not None:
        d = depths(nodes, stage).groupBy("pair_id").agg(F.max("depth").alias("d")).where(F.col("d") > limits.max_tree_depth)
        out.append(d.select("pair_id", F.concat(F.lit("depth: "), F.col("d").cast("string")).alias("message")))
    return reduce(DataFrame.unionByName, out).groupBy("pair_id").agg(F.min("message").alias("message"))
