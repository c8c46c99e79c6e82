"""The reconciliation of many tree pairs as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arboris.operators import align, causal, classify, evidence, explain, match, normalize, validate
from arboris.operators.number import numbered
from arboris.profiles import Bundle
from arboris.schema import NODES, SOURCE, TARGET
from arboris.storage import kept, kept_alone


@dataclass
class Result:
    """Tables of a reconciliation. Each is made when it is asked for; those used more than once are staged in the shared folder."""

    raw: DataFrame
    bundle: Bundle

    @cached_property
    def over_size(self) -> DataFrame:
        return validate.over_limits(self.raw, self.bundle.limits)

    @cached_property
    def evidence(self) -> DataFrame:
        """Normalised nodes with evidence, of the pairs within the limits of size and depth."""
        raw, limits = self.raw, self.bundle.limits
        if limits.max_node_count is not None or limits.max_tree_depth is not None:
            raw = raw.join(self.over_size, "pair_id", "left_anti")
        # properties are read from ``raw``; only what is compared goes through the joins
        nodes = normalize.normalize(raw, self.bundle.normalization)
        return kept_alone(lambda: evidence.extract(nodes, kept))

    @cached_property
    def over_candidates(self) -> DataFrame:
        """pair_id and message of pairs with more candidates than the limit, counted before any is made."""
        profile = self.bundle.matching
        sure = match.authoritative(self.evidence, profile).where(F.col("state") == match.CONFIRMED)
        n = match.candidate_counts(self.evidence, sure, profile).where(F.col("n") > self.bundle.limits.max_candidates)
        return kept(n.select("pair_id", F.concat(F.lit("candidates: "), F.col("n").cast("string")).alias("message")))

    @cached_property
    def over_limits(self) -> DataFrame:
        """pair_id and message of the pairs that aren't compared because they break a limit."""
        return self.over_size if self.bundle.limits.max_candidates is None else self.over_size.unionByName(self.over_candidates)

    @cached_property
    def nodes(self) -> DataFrame:
        """The nodes that are compared: ``evidence`` of the pairs within all limits."""
        if self.bundle.limits.max_candidates is None:
            return self.evidence
        return kept(self.evidence.join(self.over_candidates, "pair_id", "left_anti"))

    @cached_property
    def status(self) -> DataFrame:
        """pair_id and complete: false for pairs over a limit, of which every other table but the diagnostics is empty."""
        over = self.over_limits.select("pair_id").distinct().withColumn("over", F.lit(True))
        return self.raw.select("pair_id").distinct().join(over, "pair_id", "left").select("pair_id", F.col("over").isNull().alias("complete"))

    @cached_property
    def graph(self) -> match.Graph:
        return match.graph(self.nodes, self.bundle.matching, kept)

    @property
    def sure(self) -> DataFrame:
        """Confirmed and rejected matches, as ``matches`` has them."""
        return self.graph.sure

    @cached_property
    def open_nodes(self) -> DataFrame:
        """pair_id, side, node_ref, confidence and evidence of the ambiguous nodes."""
        return kept(self.graph.open_nodes())

    @property
    def matches(self) -> DataFrame:
        """Every match, on request: k nodes alike on both sides have k * k ambiguous ones. No later stage needs it, and it is made
        where it is read instead of being staged."""
        return self.graph.edges()

    @cached_property
    def tops(self) -> DataFrame:
        """The nodes without a parent: pair_id, side, node_ref, node_type, parent_ref, and kids, whether they have children."""
        return kept(self.nodes.where("parent_ref is null").select("pair_id", "side", "node_ref", "node_type", "parent_ref", (F.col("child_signature") != "").alias("kids")))

    @cached_property
    def pairs(self) -> DataFrame:
        """pair_id, sp, tp, node_type, s_kids, t_kids: corresponding nodes, whose children, if they have any, are aligned."""
        return kept(align.parent_pairs(self.tops, self.graph.ends))

    @cached_property
    def linked(self) -> DataFrame:
        """Confirmed pairs of nodes with parents, and whether the parents correspond."""
        return kept(align.linked(self.graph.ends, self.pairs))

    @cached_property
    def positions(self) -> DataFrame:
        return kept(align.positions(self.nodes, self.tops, self.pairs, self.linked, self.open_nodes, self.graph))

    @cached_property
    def regions(self) -> DataFrame:
        pairs, positions = self.pairs, self.positions
        return kept_alone(lambda: align.regions(pairs, positions, self.bundle.alignment))

    @cached_property
    def context(self) -> classify.Context:
        return classify.Context(self.graph.ends, self.linked, self.open_nodes, self.positions, self.regions, self.bundle.operation, kept)

    @cached_property
    def operations(self) -> DataFrame:
        return kept(classify.classify(self.context))

    @property
    def siblings(self) -> DataFrame:
        """pair_id, operation_id, sp, tp, pos, s, t, match_id: what reorders reorder, a row each."""
        return classify.siblings(self.regions, self.positions)

    @cached_property
    def explanations(self) -> DataFrame:
        rows = explain.explanations(self.operations, self.open_nodes, self.nodes)
        none = self.over_limits.select("pair_id", F.lit("explanation-incomplete").alias("explanation_id"), F.lit(0).cast("long").alias("n_roots"), F.lit(0.0).alias("objective_score"), F.lit(0.0).alias("confidence"))
        return rows.unionByName(none.distinct())

    @cached_property
    def _reached(self) -> tuple[DataFrame, DataFrame]:
        reach, below = explain.reached(self.operations, self.positions, self.pairs, self.tops, self.graph.ends, self.nodes, self.siblings, kept)
        return kept(reach), below

    @property
    def reach(self) -> DataFrame:
        """pair_id, operation_id, type, confidence, group_id: the groups of nodes that operations move along with them."""
        return self._reached[0]

    @property
    def reach_groups(self) -> DataFrame:
        """pair_id, group_id, node_ref: the members of groups, on request. Effects need only their sizes."""
        reach, below = self._reached
        return explain.members(self.positions, below).join(reach.select("pair_id", "group_id").distinct(), ["pair_id", "group_id"], "left_semi")

    @property
    def affected(self) -> DataFrame:
        """Each node of each operation, on request: operations times siblings under one parent."""
        return explain.affected(self.reach, self.reach_groups)

    def causal_links(self) -> DataFrame:
        """pair_id, cause, effect: which operations follow from which moves."""
        return causal.links(self.operations, self.reach, self.reach_groups)

    def causal_circles(self) -> DataFrame:
        """pair_id, node, circle: operations whose causes run in a circle; an explanation with one can't be told."""
        return causal.circles(self.causal_links().select("pair_id", F.col("cause").alias("a"), F.col("effect").alias("b")))

    def affected_refs(self) -> DataFrame:
        """pair_id, effect_id, affected_refs: the sorted list of each effect, on request."""
        rows = self.effects.select("pair_id", "effect_id", F.col("root_operation_id").alias("operation_id")).join(self.affected, ["pair_id", "operation_id"])
        return rows.groupBy("pair_id", "effect_id").agg(F.sort_array(F.collect_list("node_ref")).alias("affected_refs"))

    @cached_property
    def effects(self) -> DataFrame:
        reach, sizes = self.reach, explain.sizes(self.positions, self._reached[1])
        return kept_alone(lambda: explain.suppress(reach, sizes, self.bundle.suppression, kept))

    @cached_property
    def retained(self) -> DataFrame:
        return explain.retained_defects(self.operations, self.reach, self.reach_groups, self.bundle.suppression)

    @cached_property
    def diagnostics(self) -> DataFrame:
        """pair_id, ordinal, code, severity, stage, message, metadata, in the order in which stages report."""
        text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

        def rows(df: DataFrame, rank: int, key, code: str, severity: str, stage: str, message, **meta) -> DataFrame:
            data = F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v.cast("string")))) if meta else F.create_map().cast("map<string,string>")
            return df.select("pair_id", F.lit(rank).alias("rank"), key.alias("key"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(stage).alias("stage"), message.alias("message"), data.alias("metadata"))

        dup = evidence.duplicate_ids(self.nodes)
        out = [
            rows(self.over_limits, 0, F.lit(""), "RESOURCE_LIMIT_EXCEEDED", "ERROR", "limits", F.col("message")),
            rows(dup, 1, F.concat("side", F.lit("|"), "persistent_id"), "DUPLICATE_PERSISTENT_ID", "WARNING", "evidence", text("id ", F.col("persistent_id"), " stands on more than one node"), side=F.col("side"), persistent_id=F.col("persistent_id")),
            rows(self.regions.where("unresolved"), 3, F.col("region_id"), "UNRESOLVED_ALIGNMENT_REGION", "WARNING", "alignment", text("region ", F.col("region_id"), " holds unresolved positions"), region_id=F.col("region_id"), n_unresolved=F.col("n_unresolved")),
        ]
        if self.bundle.alignment.strategy != "LCS":
            pairs = self.nodes.select("pair_id").distinct()
            out.append(rows(pairs, 2, F.lit(""), "ALIGNMENT_STRATEGY_NOT_IMPLEMENTED", "WARNING", "alignment", F.lit(f"{self.bundle.alignment.strategy} falls back to ordered alignment")))
        every = reduce(DataFrame.unionByName, out)
        return kept_alone(lambda: numbered(every, ["pair_id"], ["rank", "key"], "ordinal").drop("rank", "key"))

    @cached_property
    def metrics(self) -> DataFrame:
        """pair_id, stage, candidates and results of each stage of the compared pairs, zeros too; times are the cluster's own affair."""
        return self.stage_counts("MATCHING", "ALIGNMENT", "CLASSIFICATION", "SUPPRESSION")

    def stage_counts(self, *stages: str) -> DataFrame:
        """``metrics`` of some stages. Stages after these aren't made for it."""
        sure = F.sum(F.when(F.col("state") == match.CONFIRMED, F.col("n")).otherwise(0))
        tables = {"ALIGNMENT": lambda: self.regions, "CLASSIFICATION": lambda: self.operations, "SUPPRESSION": lambda: self.effects}
        counts = [("MATCHING", self.graph.counts(), F.sum("n"), sure)] if "MATCHING" in stages else []
        counts += [(name, df(), F.lit(0).cast("long"), F.count(F.lit(1))) for name, df in tables.items() if name in stages]
        out = [df.groupBy("pair_id").agg(c.alias("candidates"), n.alias("results")).withColumn("stage", F.lit(name)) for name, df, c, n in counts]
        found = reduce(DataFrame.unionByName, out)
        every = self.nodes.select("pair_id").distinct().withColumn("stage", F.explode(F.array(*(F.lit(name) for name, *_ in counts))))
        return every.join(found, ["pair_id", "stage"], "left").fillna(0, ["candidates", "results"])

    @cached_property
    def node_counts(self) -> DataFrame:
        """pair_id and the numbers of source and target nodes."""
        return self.raw.groupBy("pair_id").agg(*(F.count_if(F.col("side") == x).alias(n) for x, n in ((SOURCE, "source_nodes"), (TARGET, "target_nodes"))))

    def metrics_fingerprint(self) -> DataFrame:
        """pair_id and a digest of the node counts and of each stage's counts."""
        stages = self.metrics.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("stage", "candidates", "results"))).alias("stages"))  # a few stages
        rows = self.node_counts.join(stages, "pair_id", "left")
        return rows.select("pair_id", F.sha2(F.to_json(F.struct("source_nodes", "target_nodes", "stages")).cast("binary"), 256).alias("fingerprint"))

    def performance_fingerprint(self) -> DataFrame:
        """pair_id and a digest of how much was compared and found: nodes, candidates, matches, operations."""
        matching = self.metrics.where("stage = 'MATCHING'").select("pair_id", "candidates", F.col("results").alias("matches"))
        operations = self.metrics.where("stage = 'CLASSIFICATION'").select("pair_id", F.col("results").alias("operations"))
        rows = self.node_counts.join(matching, "pair_id", "left").join(operations, "pair_id", "left")
        return rows.select("pair_id", F.sha2(F.to_json(F.struct("source_nodes", "target_nodes", "candidates", "matches", "operations")).cast("binary"), 256).alias("fingerprint"))

    def fingerprint(self) -> DataFrame:
        """pair_id and a digest of the pair's operations, matches (ambiguous ones by classes and their nodes) and effects, in their fixed order."""
        parts = [
            self.operations.select("pair_id", F.to_json(F.struct("operation_id", "type", "source_refs", "target_refs", "from_parent", "to_parent", "confidence", "evidence_codes")).alias("x")),
            self.siblings.select("pair_id", F.to_json(F.struct("operation_id", "s", "t")).alias("x")),
            self.sure.select("pair_id", F.to_json(F.struct("match_id", "state", "score", "confidence", "evidence")).alias("x")),
            self.graph.ambiguous.select("pair_id", F.to_json(F.struct("s_class", "t_class", "score", "n_s", "n_t")).alias("x")),
            self.graph.members.join(self.open_nodes.select("pair_id", "side", "node_ref"), ["pair_id", "side", "node_ref"]).select("pair_id", F.to_json(F.struct("side", "class_id", "node_ref")).alias("x")),
            self.effects.select("pair_id", F.to_json(F.struct("effect_id", "root_operation_id", "rule_id", "n_affected", "refs_digest")).alias("x")),
        ]
        # digests of rows, then of cells of rows: a pair with most rows is no single task's list
        rows = reduce(DataFrame.unionByName, parts).select("pair_id", F.sha2(F.col("x").cast("binary"), 256).alias("h"))
        digest = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "").cast("binary"), 256)
        cells = rows.groupBy("pair_id", F.substring("h", 1, 3).alias("cell")).agg(digest("h").alias("h"))
        cells = cells.select("pair_id", F.concat("cell", "h").alias("h"))
        return cells.groupBy("pair_id").agg(digest("h").alias("fingerprint"))


def reconcile(nodes: DataFrame, bundle: Bundle) -> Result:
    """Reconcile all pairs of a node table (``schema.NODES``) under one bundle."""
    missing = [c for c in NODES.names if c not in nodes.columns]
    if missing:
        raise ValueError(f"not a node table, it lacks {missing}")
    return Result(nodes.select(*NODES.names), bundle)
