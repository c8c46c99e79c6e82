"""Events of comparisons: what each stage counted and how each job ended, never what the texts say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arboris.functions.text import redacted_json
from arboris.operators.match import AMBIGUOUS, CONFIRMED
from arboris.plans.localization import Localization

STAGE, OUTCOME = "comparison.stage", "comparison.outcome"
COUNTS = (
    "source_node_count", "target_node_count", "candidate_count", "match_count", "ambiguity_count", "operation_count", "suppression_count", "recommendation_count",
)


def events(jobs: DataFrame, loc: Localization) -> DataFrame:
    """job_id, correlation_id, event, stage and fields (a JSON text): an event for each stage of each compared job of
    ``jobs`` (pair_id, state, correlation_id), and one for the outcome of every job. A job that wasn't compared has zero counts."""
    r = loc.result
    n = lambda df, name: df.groupBy("pair_id").agg(F.count(F.lit(1)).alias(name))
    states = r.graph.counts().groupBy("pair_id").agg(*(F.sum(F.when(F.col("state") == s, F.col("n")).otherwise(0)).alias(c) for s, c in ((CONFIRMED, "match_count"), (AMBIGUOUS, "ambiguity_count"))))
    counted = [
        r.node_counts.select("pair_id", F.col("source_nodes").alias("source_node_count"), F.col("target_nodes").alias("target_node_count")), states,
        r.metrics.groupBy("pair_id").agg(F.sum("candidates").alias("candidate_count")), n(r.operations, "operation_count"), n(r.effects, "suppression_count"),
        n(loc.findings.where("repair"), "recommendation_count"), loc.findings.groupBy("pair_id").agg(F.bool_or(F.col("severity") == "ERROR").alias("completed_with_issues")),
    ]
    rows = reduce(lambda a, b: a.join(b, "pair_id", "left"), counted, jobs.select("pair_id", "state", "correlation_id"))
    done = F.col("state") == "COMPLETED"
    fields = F.to_json(F.struct(
        F.col("state").alias("outcome"), (~done).alias("technical_failure"), (done & F.coalesce("completed_with_issues", F.lit(False))).alias("completed_with_issues"),
        *(F.when(done, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c) for c in COUNTS),
    ))
    outcome = rows.select(F.col("pair_id").alias("job_id"), "correlation_id", F.lit(OUTCOME).alias("event"), F.lit(None).cast("string").alias("stage"), fields.alias("fields"))
    stages = r.metrics.join(jobs.where(done).select("pair_id", "correlation_id"), "pair_id")
    stage = stages.select(F.col("pair_id").alias("job_id"), "correlation_id", F.lit(STAGE).alias("event"), "stage", F.to_json(F.struct("stage", "candidates", "results")).alias("fields"))
    return stage.unionByName(outcome)


def emit(rows: DataFrame, path: str, with_content: bool = False) -> dict[str, int]:
    """Append events as JSON lines with credentials (and contents) masked, and say how many of each kind the same pass wrote."""
    seen = Observation()
    masked = rows.withColumn("fields", redacted_json(F.col("fields"), with_content))
    counts = (F.count_if(F.col("event") == STAGE).alias("stages"), F.count_if(F.col("event") == OUTCOME).alias("outcomes"))
    masked.observe(seen, *counts).write.mode("append").json(path)
    return seen.get
