"""Causal explanations and suppression of derived effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arboris.operators.align import ALIGNED
from arboris.operators.evidence import descendants
from arboris.operators.number import numbered
from arboris.profiles import Suppression
from arboris.schema import SOURCE, TARGET

#: What an operation of each type costs an explanation. Fixed values.
COSTS = {"MATCH": 0.0, "UPDATE": 1.0, "INSERT": 1.0, "DELETE": 1.0, "MOVE": 1.5, "REORDER": 1.2}


def explanations(operations: DataFrame, ambiguous: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, explanation_id, n_roots, objective_score, confidence of each of ``pairs``, twice where it is in ``ambiguous``;
    root operations by ``root_operations``.

    Sums are of decimals, so that they do not depend on the order of the rows.
    """
    cost = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in COSTS.items() for x in kv)), F.col("type")), F.lit(1.0))
    exact = F.col("confidence").cast("decimal(18,6)")
    changed = F.col("type") != "MATCH"
    rows = operations.groupBy("pair_id").agg(
        F.count_if(changed).alias("n_roots"), F.sum(exact - cost.cast("decimal(18,6)")).cast("double").alias("objective_score"),
        F.coalesce(F.round(F.avg(F.when(changed, exact)).cast("double"), 6), F.lit(1.0)).alias("confidence"),
    )
    rows = pairs.select("pair_id").distinct().join(rows, "pair_id", "left").fillna({"n_roots": 0, "objective_score": 0.0, "confidence": 1.0})
    open_ = ambiguous.select("pair_id").distinct()
    primary = rows.withColumn("explanation_id", F.lit("explanation-primary"))
    return primary.unionByName(rows.join(open_, "pair_id", "left_semi").withColumn("explanation_id", F.lit("explanation-ambiguous-alternative")))


def root_operations(operations: DataFrame) -> DataFrame:
    return operations.where("type <> 'MATCH'").select("pair_id", "operation_id")


def _region() -> Column:
    return F.concat(F.lit("region:"), F.length("sp").cast("string"), F.lit(":"), "sp", "tp").alias("group_id")


def reached(operations: DataFrame, positions: DataFrame, pairs: DataFrame, tops: DataFrame, ends: DataFrame, nodes: DataFrame, siblings: DataFrame, stage=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """What operations move along with them, in groups of nodes: pair_id, operation_id, type, confidence, group_id; and
    what is below moved nodes: pair_id, side, top, node_ref.

    A group is the aligned children of a region, or what is below a moved node. A thousand insertions under one parent
    reach one group; a node is in one region, so no operation reaches a node twice.
    """
    keys = ["pair_id", "operation_id", "type", "confidence"]
    ops = operations.select(*keys, "source_refs", "target_refs")
    aligned = F.col("kind") == ALIGNED

    def regions(type_: str, refs: str, end: str, which: str) -> DataFrame:
        # only below roots, which are in several pairs, is what is left over in one region aligned in another
        parent = f"{end}p"
        top = tops.where(F.col("side") == which).select("pair_id", F.col("node_ref").alias(parent)).distinct()
        first = positions.where(aligned).join(top, ["pair_id", parent], "left_semi").select("pair_id", "sp", "tp", end)
        places = positions.where(~aligned & F.col(end).isNotNull()).select(*first.columns).unionByName(first)
        at = ops.where(F.col("type") == type_).select(*keys, F.explode(refs).alias("ref"))
        return at.join(places.select("pair_id", F.col(end).alias("ref"), _region()), ["pair_id", "ref"]).select(*keys, "group_id")

    # a reorder reaches the region of its siblings and the regions under them
    orders = ops.where("type = 'REORDER'").select(*keys)
    among = orders.join(siblings.select("pair_id", "operation_id", _region()).distinct(), ["pair_id", "operation_id"])
    under = pairs.where("s_kids or t_kids").select("pair_id", F.col("sp").alias("s"), _region()).join(siblings.select("pair_id", "operation_id", "s"), ["pair_id", "s"])
    under = orders.join(under.select("pair_id", "operation_id", "group_id"), ["pair_id", "operation_id"])
    moves = ops.where("type = 'MOVE'").select(*keys, F.col("source_refs")[0].alias("top"))
    # below a node without children there is nothing to look for, and matches know who has some
    parents = ends.where("s_kids").select("pair_id", F.col("s").alias("top"))
    moved = stage(moves.select("pair_id", F.lit(SOURCE).alias("side"), "top").distinct().join(parents, ["pair_id", "top"], "left_semi"))
    below = descendants(nodes, moved, stage)
    reach = [
        regions("INSERT", "target_refs", "t", TARGET), regions("DELETE", "source_refs", "s", SOURCE), among, under, moves.select(*keys, _subtree()),
    ]
    return reduce(DataFrame.unionByName, reach).distinct(), below


def _subtree() -> Column:
    return F.concat(F.lit("below:"), "top").alias("group_id")


def _lined(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("kind") == ALIGNED).select("pair_id", "sp", "tp", F.col("t").alias("node_ref")).distinct()


def members(positions: DataFrame, below: DataFrame) -> DataFrame:
    """pair_id, group_id, node_ref of every group that ``reached`` can name."""
    return _lined(positions).select("pair_id", _region(), "node_ref").unionByName(below.select("pair_id", _subtree(), "node_ref").distinct())


def sizes(positions: DataFrame, below: DataFrame) -> DataFrame:
    """pair_id, group_id, n, low, high, digest: how many nodes the groups of ``members`` have, the first and last of them and
    the sum of their hashes. Names of groups are made for these rows, not for nodes."""
    h = F.xxhash64("node_ref")
    # sums of both halves of the bits are longs, and faster than sums of decimals
    high, low = F.sum(F.shiftright(h, 32)).cast("decimal(20,0)"), F.sum(h.bitwiseAND((1 << 32) - 1)).cast("decimal(20,0)")
    digest = (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(28,0)")
    of = (F.count(F.lit(1)).alias("n"), F.min("node_ref").alias("low"), F.max("node_ref").alias("high"), digest.alias("digest"))
    columns = ["n", "low", "high", "digest"]
    lined = _lined(positions).groupBy("pair_id", "sp", "tp").agg(*of).select("pair_id", _region(), *columns)
    return lined.unionByName(below.select("pair_id", "top", "node_ref").distinct().groupBy("pair_id", "top").agg(*of).select("pair_id", _subtree(), *columns))


def affected(reach: DataFrame, groups: DataFrame) -> DataFrame:
    """pair_id, operation_id, type, confidence, node_ref: each node of each operation. On request only: under one
    parent these are as many as its operations times its children."""
    return reach.join(groups, ["pair_id", "group_id"]).select("pair_id", "operation_id", "type", "confidence", "node_ref")


def suppress(reach: DataFrame, sizes: DataFrame, profile: Suppression, stage=lambda df: df) -> DataFrame:
    """Effects: pair_id, effect_id, root_operation_id, rule_id, category, n_affected, first_ref, last_ref, refs_digest,
    confidence, independent_defect_check. ``refs_digest`` is a sum of hashes of the affected nodes."""
    spark = reach.sparkSession
    schema = "rule_pos int, rule_id string, type string, category string, threshold double"
    rules = spark.createDataFrame([(i, r.rule_id, r.root_operation, r.effect_category, r.threshold) for i, r in enumerate(profile.rules)], schema)
    rows = reach.join(sizes, ["pair_id", "group_id"]).groupBy("pair_id", "operation_id", "type", "confidence")
    rows = rows.agg(F.sum("n").alias("n_affected"), F.min("low").alias("first_ref"), F.max("high").alias("last_ref"), F.sum("digest").cast("string").alias("refs_digest"))
    rows = rows.join(F.broadcast(rules), "type").where("confidence >= threshold")  # a profile's few rules
    rows = numbered(stage(rows), ["pair_id"], ["type", "operation_id", "rule_pos"], "effect_no")
    check = F.when(F.col("type") == "MOVE", "PASSED").otherwise("NOT_APPLICABLE")
    return rows.select(
        "pair_id", F.concat(F.lit("effect-"), F.col("effect_no").cast("string")).alias("effect_id"), F.col("operation_id").alias("root_operation_id"),
        "rule_id", "category", "n_affected", "first_ref", "last_ref", "refs_digest", "confidence", check.alias("independent_defect_check"),
    )


def retained_defects(operations: DataFrame, reach: DataFrame, groups: DataFrame, profile: Suppression) -> DataFrame:
    """pair_id, node_ref: updated nodes inside moved subtrees, which stay visible."""
    least = [r.threshold for r in profile.rules if r.root_operation == "MOVE"]
    moved = affected(reach.where((F.col("type") == "MOVE") & (F.col("confidence") >= min(least, default=2.0))), groups)
    updated = operations.where("type = 'UPDATE'").select("pair_id", F.explode("source_refs").alias("node_ref"))
    return updated.join(moved, ["pair_id", "node_ref"], "left_semi").distinct()
