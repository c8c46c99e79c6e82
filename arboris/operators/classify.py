"""Classification of aligned positions into an edit script."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arboris.operators.align import ALIGNED, SOURCE_ONLY, TARGET_ONLY
from arboris.profiles import Operation
from arboris.schema import SOURCE, TARGET

COLUMNS = ("pair_id", "operation_id", "type", "source_refs", "target_refs", "from_parent", "to_parent", "confidence", "match_ids", "evidence_codes", "preconditions")
FORCED = "UNRESOLVED_CORRESPONDENCE_FORCED_BY_POLICY"


class Context:
    """What classifiers read: confirmed pairs, those of nodes with parents, ambiguous nodes, positions, regions, the profile; and the moves, made once."""

    def __init__(self, ends: DataFrame, linked: DataFrame, open_nodes: DataFrame, positions: DataFrame, regions: DataFrame, profile: Operation, stage=lambda df: df):
        self.ends, self.linked, self.open_nodes, self.positions, self.regions, self.profile = ends, linked, open_nodes, positions, regions, profile
        self.moves = stage(self._moves())

    def _moves(self) -> DataFrame:
        """Confirmed pairs under parents that do not correspond, sure enough: pair_id, s, t, sp, tp, expected, match_id, confidence."""
        rows = self.linked.where(~F.col("aligned") & (F.col("confidence") >= self.profile.move_confidence_threshold))
        expected = self.ends.select("pair_id", F.col("s").alias("sp"), F.col("t").alias("expected"))
        return rows.select("pair_id", "s", "t", "sp", "tp", "match_id", "confidence").join(expected, ["pair_id", "sp"], "left")


def _operations(df: DataFrame, type_: str, key, source, target, confidence, codes, match_ids=None, from_parent=None, to_parent=None, preconditions=()) -> DataFrame:
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    return df.select(
        "pair_id", F.concat(F.lit(f"op:{type_.lower()}:"), key).alias("operation_id"), F.lit(type_).alias("type"), (source if source is not None else none).alias("source_refs"),
        (target if target is not None else none).alias("target_refs"), (from_parent if from_parent is not None else null).alias("from_parent"),
        (to_parent if to_parent is not None else null).alias("to_parent"), confidence.cast("double").alias("confidence"), (match_ids if match_ids is not None else none).alias("match_ids"),
        codes.alias("evidence_codes"), F.array(*map(F.lit, preconditions)).cast("array<string>").alias("preconditions"),
    )


def match_update(c: Context) -> DataFrame:
    rows = c.positions.where(F.col("kind") == ALIGNED)
    out = []
    for type_, code, same in (("MATCH", "IDENTITY_PRESERVED", True), ("UPDATE", "CONTENT_CHANGED", False)):
        kind = rows.where(F.col("same") == same)
        out.append(_operations(kind, type_, F.concat("s", F.lit("->"), "t"), F.array("s"), F.array("t"), F.col("confidence"), F.array(F.lit(code)), F.array("match_id")))
    return out[0].unionByName(out[1])


def insert_delete(c: Context) -> DataFrame:
    policy = c.profile.presence_policy
    rows = c.positions.where(F.col("kind") != ALIGNED)
    if policy == "SUPPRESS_UNRESOLVED_REGIONS":
        rows = rows.join(c.regions.where("unresolved").select("pair_id", "sp", "tp"), ["pair_id", "sp", "tp"], "left_anti")
    if policy != "EMIT_ALL":
        rows = rows.where(F.col("kind").isin(SOURCE_ONLY, TARGET_ONLY))
    forced = F.col("kind").startswith("UNRESOLVED")
    out = []
    for type_, end, side, code in (("DELETE", "s", SOURCE, SOURCE_ONLY), ("INSERT", "t", TARGET, TARGET_ONLY)):
        # each end by itself: rows without it would all meet in a task per pair
        kind = rows.where(F.col(end).isNotNull())
        if policy != "EMIT_ALL":  # the second barrier: whatever the aligner says
            kind = kind.join(c.open_nodes.where(F.col("side") == side).select("pair_id", F.col("node_ref").alias(end)), ["pair_id", end], "left_anti")
        kind = kind.join(c.moves.select("pair_id", end), ["pair_id", end], "left_anti")
        codes = F.when(forced, F.array(F.lit(code), F.lit(FORCED))).otherwise(F.array(F.lit(code)))
        refs = F.array(end)
        out.append(_operations(kind, type_, F.col(end), refs if end == "s" else None, refs if end == "t" else None, F.lit(1.0), codes))
    return out[0].unionByName(out[1])


def move(c: Context) -> DataFrame:
    codes = F.array(F.lit("CONFIRMED_IDENTITY"), F.lit("PARENT_CHANGED"))
    return _operations(c.moves, "MOVE", F.concat("s", F.lit("->"), "t"), F.array("s"), F.array("t"), F.col("confidence"), codes, F.array("match_id"), F.col("expected"), F.col("tp"), ("SOURCE_AND_TARGET_MATCH_REMAINS_VALID",))


def siblings(regions: DataFrame, positions: DataFrame) -> DataFrame:
    """pair_id, operation_id, sp, tp, pos, s, t, match_id: the members of each reorder's class of siblings, a row each."""
    changed = regions.where("order_changed").select("pair_id", "sp", "tp", F.concat(F.lit("op:reorder:"), "sp").alias("operation_id"))
    rows = positions.where(F.col("kind") == ALIGNED).join(changed, ["pair_id", "sp", "tp"])
    return rows.select("pair_id", "operation_id", "sp", "tp", "pos", "s", "t", "match_id")


def reorder(c: Context) -> DataFrame:
    """Reorders name the first and the last of their siblings; ``siblings`` has all of them."""
    at = F.struct("pos", "s")
    ends = lambda column: F.array(F.min_by(column, at), F.max_by(column, at))
    rows = siblings(c.regions, c.positions).groupBy("pair_id", "sp", "tp").agg(*(ends(n).alias(f"{n}s") for n in ("s", "t", "match_id")))
    return _operations(rows, "REORDER", F.col("sp"), F.col("ss"), F.col("ts"), F.lit(1.0), F.array(F.lit("SIBLING_ORDER_CHANGED")), F.col("match_ids"))


#: Classifiers by unique name, in order.
CLASSIFIERS: dict[str, Callable[[Context], DataFrame]] = {"match-update": match_update, "insert-delete": insert_delete, "move": move, "reorder": reorder}


def classify(c: Context, classifiers: dict[str, Callable[[Context], DataFrame]] | None = None) -> DataFrame:
    """Operations of all classifiers whose type is enabled."""
    every = reduce(DataFrame.unionByName, (f(c).select(*COLUMNS) for f in (classifiers or CLASSIFIERS).values()))
    return every.where(F.col("type").isin(*sorted(c.profile.enabled)))
