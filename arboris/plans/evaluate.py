"""Quality of a reconciliation against labelled cases, and a report of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arboris.plans.engine import Result


def _rate(n: Column, d: Column) -> Column:
    """n / d, and 1.0 of nothing."""
    return F.when(d == 0, F.lit(1.0)).otherwise(F.try_divide(n, d))


def _compared(found: DataFrame, expected: DataFrame, keys: list[str], kind: str | Column) -> DataFrame:
    """kind, true_positives, false_positives, false_negatives, precision and recall of ``found`` rows."""
    f, e = found.select(*keys).distinct().withColumn("_f", F.lit(1)), expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    rows = f.join(e, keys, "full_outer").withColumn("kind", F.lit(kind) if isinstance(kind, str) else kind)
    tp, fp, fn = F.count_if(F.col("_f").isNotNull() & F.col("_e").isNotNull()), F.count_if(F.col("_e").isNull()), F.count_if(F.col("_f").isNull())
    return rows.groupBy("kind").agg(tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), _rate(tp, tp + fp).alias("precision"), _rate(tp, tp + fn).alias("recall"))


def quality(result: Result, matches: DataFrame, operations: DataFrame) -> DataFrame:
    """Precision and recall of confirmed matches (pair_id, s, t) and of each type of operation but MATCH
    (pair_id, operation_id, type), by what was expected."""
    got = result.sure.where("state = 'CONFIRMED'")
    ops = result.operations.where("type <> 'MATCH'")
    return _compared(got, matches, ["pair_id", "s", "t"], "MATCH").unionByName(_compared(ops, operations, ["pair_id", "operation_id", "type"], F.col("type")))


def ambiguity_rate(result: Result) -> DataFrame:
    """pair_id and the share of source nodes below the root that are ambiguous."""
    nodes = result.nodes.where("side = 'S' and parent_ref is not null").select("pair_id", F.col("node_ref").alias("s"))
    amb = result.open_nodes.where("side = 'S'").select("pair_id", F.col("node_ref").alias("s"), F.lit(1).alias("_a"))
    return nodes.join(amb, ["pair_id", "s"], "left").groupBy("pair_id").agg(_rate(F.count("_a"), F.count(F.lit(1))).alias("ambiguity_rate"))


def cascade_reduction(result: Result) -> DataFrame:
    """pair_id and the share of findings (changes and derived effects) that suppression takes off the list."""
    changes = result.operations.where("type <> 'MATCH'").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    derived = result.effects.groupBy("pair_id").agg(F.sum("n_affected").alias("d"))
    rows = changes.join(derived, "pair_id", "left").withColumn("d", F.coalesce("d", F.lit(0).cast("long")))
    return rows.select("pair_id", (F.col("d") / (F.col("d") + F.col("n"))).alias("cascade_reduction"))


def markdown(rows: DataFrame) -> str:
    """A small table (quality, say) as Markdown."""
    lines = [rows.columns, ["-"] * len(rows.columns), *([f"{v:.2f}" if isinstance(v, float) else str(v) for v in r] for r in rows.orderBy(rows.columns[0]).collect())]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"
