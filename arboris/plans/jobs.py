"""Batches of comparison requests: states and errors are rows, not exceptions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arboris import profiles
from arboris.operators.validate import first_violations, tree_violations
from arboris.plans.engine import Result, reconcile
from arboris.plans.localization import Localization, Policy
from arboris.sources import documents
from arboris.storage import kept

RANK = {"INFO": 0, "WARNING": 1, "ERROR": 2}


@dataclass
class Batch:
    """Jobs of a batch, and the localization of each profile's completed pairs."""

    jobs: DataFrame
    by_profile: dict[str, Localization]


def compare(requests: DataFrame, locale: str, policy: Policy | None = None, bundles: dict[str, profiles.Bundle] | None = None) -> Batch:
    """Run ``requests`` (pair_id, profile_id, source_content, locale_content); one plan per known profile."""
    bundles = bundles or profiles.BUNDLES
    requests = kept(requests)
    unknown = requests.where(~F.coalesce(F.col("profile_id").isin(*bundles), F.lit(False)))
    states = [unknown.select("pair_id", F.lit("REJECTED").alias("state"), F.lit("UNSUPPORTED_CONTRACT").alias("error_code"), F.lit("no such profile").alias("error_message"))]
    done = {}
    for name, bundle in bundles.items():
        mine = requests.where(F.col("profile_id") == name)
        both = mine.select("pair_id", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("content")) for s, c in (("S", "source_content"), ("T", "locale_content"))))))
        parsed = kept(documents.parse(both, name))
        bad = documents.refused(parsed).groupBy("pair_id").agg(F.min_by("error_code", "side").alias("error_code"), F.min_by("error_message", "side").alias("error_message"))
        states.append(bad.select("pair_id", F.lit("REJECTED").alias("state"), "error_code", "error_message"))
        good = documents.nodes_of(parsed).join(bad, "pair_id", "left_anti")
        result = reconcile(good, bundle)
        states += _ended(good, result)
        done[name] = Localization(result, locale, policy=policy if policy and policy.locale == locale else None)
    return Batch(_correlated(reduce(DataFrame.unionByName, states)), done)


def _ended(good: DataFrame, result: Result) -> list[DataFrame]:
    """States of the pairs that were taken in: FAILED over a limit, else COMPLETED."""
    over, null = result.over_limits, F.lit(None).cast("string")
    failed = over.select("pair_id", F.lit("FAILED").alias("state"), F.lit("RESOURCE_LIMIT_EXCEEDED").alias("error_code"), F.col("message").alias("error_message"))
    rest = good.select("pair_id").distinct().join(over, "pair_id", "left_anti")
    return [failed, rest.select("pair_id", F.lit("COMPLETED").alias("state"), null.alias("error_code"), null.alias("error_message"))]


def _correlated(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("correlation_id", F.concat(F.lit("corr-"), "pair_id"))


def compare_trees(nodes: DataFrame, locale: str, bundle: profiles.Bundle, policy: Policy | None = None) -> Batch:
    """Compare trees that the caller built. A pair with a broken tree is REJECTED with the first rule that it breaks
    (by side, then code, then node) and isn't compared; the others are jobs as those of ``compare``."""
    nodes = kept(nodes)
    first = kept(first_violations(tree_violations(nodes)))
    bad = first.groupBy("pair_id").agg(F.min_by(F.struct("code", "side", "node_ref"), "side").alias("x"))
    rejected = bad.select("pair_id", F.lit("REJECTED").alias("state"), F.col("x.code").alias("error_code"), F.concat_ws(" ", F.lit("side"), "x.side", F.lit("node"), "x.node_ref").alias("error_message"))
    good = nodes.join(bad, "pair_id", "left_anti")
    result = reconcile(good, bundle)
    loc = Localization(result, locale, policy=policy if policy and policy.locale == locale else None)
    return Batch(_correlated(reduce(DataFrame.unionByName, [rejected, *_ended(good, result)])), {bundle.bundle_id: loc})


def from_repository(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Requests (and error rows) for ``refs`` (pair_id, profile_id, source_object, source_revision, locale_object, locale_revision)
    from ``objects`` (object_id, revision, content). A null revision takes the object without one, else its last."""
    latest = Window.partitionBy("object_id").orderBy(F.col("revision").isNotNull(), F.desc("revision"))
    default = objects.withColumn("rn", F.row_number().over(latest)).where("rn = 1").select("object_id", "content")
    exact = objects.where("revision is not null").select("object_id", "revision", "content")
    out = refs
    for side in ("source", "locale"):
        oid, rev = F.col(f"{side}_object"), F.col(f"{side}_revision")
        e = exact.select(F.col("object_id").alias("_o"), F.col("revision").alias("_r"), F.col("content").alias("_exact"))
        d = default.select(F.col("object_id").alias("_d"), F.col("content").alias("_default"))
        out = out.join(e, (oid == F.col("_o")) & (rev == F.col("_r")), "left").join(d, (oid == F.col("_d")) & rev.isNull(), "left")
        out = out.withColumn(f"{side}_content", F.coalesce("_exact", "_default")).drop("_o", "_r", "_exact", "_d", "_default")
    lost = F.col("source_content").isNull() | F.col("locale_content").isNull()
    return out.withColumn("error_code", F.when(lost, "CCMS_READ_FAILED"))


def metadata(raw: Column, names: dict[str, str]) -> Column:
    """A map with its keys renamed by ``names``; other keys are dropped, of two that get one name the later stays."""
    known = F.map_filter(raw, lambda k, v: k.isin(*names))
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    pairs = F.transform(F.map_entries(known), lambda e: F.struct(F.element_at(table, e["key"]).alias("key"), e["value"].alias("value")))
    one = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.map_from_entries(F.array(e))))
    return one


def exit_codes(jobs: DataFrame, issues: DataFrame, least: str = "WARNING") -> DataFrame:
    """pair_id and exit code: 1 if the job failed, 2 if an issue is at least that severe, else 0."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), F.col("severity"))
    worst = issues.groupBy("pair_id").agg(F.max(rank).alias("worst"))
    code = F.when(F.col("state") != "COMPLETED", 1).when(F.col("worst") >= RANK[least], 2).otherwise(0)
    return jobs.join(worst, "pair_id", "left").select("pair_id", code.alias("exit_code"))


def observability(jobs: DataFrame, loc: Localization) -> DataFrame:
    """pair_id, outcome, and counts of matches, operations, effects and issues of each job."""
    out = jobs.select("pair_id", "state", "correlation_id")
    out = out.join(loc.result.graph.counts().groupBy("pair_id").agg(F.sum("n").alias("n_matches")), "pair_id", "left")
    for name, df in (("n_operations", loc.result.operations), ("n_effects", loc.result.effects)):
        out = out.join(df.groupBy("pair_id").agg(F.count(F.lit(1)).alias(name)), "pair_id", "left")
    errors = loc.findings.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_issues"), F.bool_or(F.col("severity") == "ERROR").alias("has_errors"))
    out = out.join(errors, "pair_id", "left").fillna(0).fillna(False)
    outcome = F.when(F.col("state") != "COMPLETED", "technical_failure").when(F.col("has_errors"), "completed_with_issues").otherwise("completed")
    return out.withColumn("outcome", outcome).drop("has_errors")
