"""Reading a reconciliation as source and locale: issues, repairs, summary, decisions, prices."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arboris.functions.text import plain
from arboris.operators.match import CONFIRMED
from arboris.operators.number import numbered
from arboris.plans.engine import Result
from arboris.schema import SOURCE, TARGET
from arboris.storage import kept

# Status to severity, action and repair.
SEVERITY = {
    "CONFIRMED_MATCH": "INFO", "PROBABLE_MATCH": "INFO", "AMBIGUOUS_MATCH": "WARNING", "MISSING_IN_LOCALE": "ERROR", "EXTRA_IN_LOCALE": "WARNING", "WRONG_PARENT": "ERROR",
    "WRONG_ORDER": "WARNING", "SOURCE_UPDATED": "WARNING", "IDENTIFIER_CONFLICT": "ERROR", "EXEMPT_LOCALE_VARIATION": "INFO", "LOCALE_DIVERGED": "ERROR",
}
ACTION = {
    "AMBIGUOUS_MATCH": "REVIEW", "MISSING_IN_LOCALE": "ADD_OR_TRANSLATE", "EXTRA_IN_LOCALE": "REVIEW_OR_REMOVE",
    "WRONG_PARENT": "RELINK_OR_MOVE", "WRONG_ORDER": "REORDER", "SOURCE_UPDATED": "REVIEW_TRANSLATION",
}
REPAIR = {"WRONG_PARENT": "MOVE_NODE", "WRONG_ORDER": "REORDER_NODES", "MISSING_IN_LOCALE": "ADD_NODE", "EXTRA_IN_LOCALE": "REMOVE_NODE"}
CHANGES = {"MOVE_NODE": "CONTAINMENT", "REORDER_NODES": "ORDER", "ADD_NODE": "CONTAINMENT", "REMOVE_NODE": "CONTAINMENT"}
PRECONDITIONS = {
    "MOVE_NODE": ("INPUT_FINGERPRINT_UNCHANGED", "TARGET_NODE_EXISTS", "DESTINATION_PARENT_EXISTS", "DOMAIN_RULES_PASS"),
    "REORDER_NODES": ("INPUT_FINGERPRINT_UNCHANGED", "MATCHED_SIBLINGS_EXIST", "DOMAIN_RULES_PASS"),
    "ADD_NODE": ("INPUT_FINGERPRINT_UNCHANGED", "DESTINATION_PARENT_EXISTS", "SOURCE_NODE_AVAILABLE", "DOMAIN_RULES_PASS"),
    "REMOVE_NODE": ("INPUT_FINGERPRINT_UNCHANGED", "TARGET_NODE_EXISTS", "DOMAIN_RULES_PASS"),
}
POSTCONDITIONS = {
    "MOVE_NODE": ("TARGET_PARENT_MATCHES_AUTHORITATIVE_PARENT", "XML_REMAINS_SCHEMA_VALID"),
    "REORDER_NODES": ("SIBLING_ORDER_MATCHES_AUTHORITATIVE", "XML_REMAINS_SCHEMA_VALID"),
    "ADD_NODE": ("REQUIRED_NODE_PRESENT_IN_LOCALE", "XML_REMAINS_SCHEMA_VALID"),
    "REMOVE_NODE": ("EXTRA_NODE_REMOVED_FROM_LOCALE", "XML_REMAINS_SCHEMA_VALID"),
}
MESSAGES = {
    "WRONG_PARENT": "the node's counterpart stands under a parent that doesn't correspond",
    "SOURCE_UPDATED": "the source is newer than the revision that the locale was made from",
    "WRONG_ORDER": "counterparts under corresponding parents come in another order",
    "AMBIGUOUS_MATCH": "several nodes of the locale could correspond; someone has to choose",
    "IDENTIFIER_CONFLICT": "an identifier stands on more than one node and identifies none",
}
#: A repair is never surer than its diagnosis.
REPAIR_FACTOR = 0.9


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


@dataclass(frozen=True)
class LocaleRule:
    rule_id: str
    operation: str
    node_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    locale: str
    rules: tuple[LocaleRule, ...] = ()
    confirmed_match_threshold: float = 0.9

    def __post_init__(self):
        if len({r.rule_id for r in self.rules}) < len(self.rules):
            raise ValueError("policy rule ids must be unique")


def translation_state(s_props: list[Column], t_props: list[Column]) -> Column:
    """CURRENT, STALE or UNKNOWN, by the source's ``revision`` and the locale's ``source-revision``."""
    have = F.coalesce(*(plain(p.getItem("revision")) for p in s_props))
    known = F.coalesce(*(plain(p.getItem("source-revision")) for p in t_props))
    return revision_state(have, known)


def revision_state(have: Column, known: Column) -> Column:
    return F.when(have.isNull() | known.isNull(), "UNKNOWN").when(have == known, "CURRENT").otherwise("STALE")


def _label() -> Column:
    keys = ("navtitle", "label", "title")
    value = [F.when(x.startswith("s:") & (F.length(x) > 2), plain(x)) for k in keys for x in (F.col("content").getItem(k), F.col("identity").getItem(k))]
    return F.coalesce(*value)


@dataclass
class Localization:
    """Tables of the reading of a result for one locale."""

    result: Result
    locale: str
    authoritative_side: str = "SOURCE"
    policy: Policy | None = None

    def __post_init__(self):
        if self.policy is not None and self.policy.locale != self.locale:
            raise ValueError("the policy is for another locale")

    @cached_property
    def _named(self) -> DataFrame:
        """What issues say of nodes: pair_id, side, node_ref, node_type, parent_ref, id, label, and the revisions that ``translation_state``
        compares. Texts instead of the properties that they are from go through the joins."""
        bags = [F.col(c) for c in ("identity", "content", "structural")]
        revision = [F.coalesce(*(plain(b.getItem(k)) for b in bags)).alias(n) for k, n in (("revision", "have"), ("source-revision", "known"))]
        return kept(self.result.raw.select("pair_id", "side", "node_ref", "node_type", "parent_ref", plain(F.col("identity").getItem("id")).alias("id"), _label().alias("label"), *revision))

    def _side(self, side: str, prefix: str) -> DataFrame:
        rows = self._named.where(F.col("side") == side)
        return rows.select("pair_id", F.col("node_ref").alias(prefix), *(F.col(c).alias(f"{prefix}_{c}") for c in ("node_type", "parent_ref", "id", "label", "have", "known")))

    def _exemption(self, operation: str, node_type: Column) -> Column:
        out = F.lit(None).cast("string")
        for r in reversed(self.policy.rules if self.policy else ()):
            if r.operation == operation:
                fits = F.lit(True) if not r.node_types else node_type.isin(*r.node_types)
                out = F.when(fits, F.lit(r.rule_id)).otherwise(out)
        return out

    @cached_property
    def _found(self) -> DataFrame:
        """A row for each finding, contradictions too: what it says, and ``block`` and ``key``, by which issues are in order."""
        r = self.result
        s, t = self._side(SOURCE, "s"), self._side(TARGET, "t")
        null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
        number = F.lit(None).cast("double")

        def rows(df: DataFrame, block: int, key: Column, status: Column, **values: Column) -> DataFrame:
            base = dict(
                source_ref=null, locale_ref=null, source_id=null, locale_id=null, source_label=null, locale_label=null, match_ids=none, operation_ids=none,
                match_confidence=number, operation_confidence=number, translation_state=null, exemption=null, message=null,
            )
            columns = (v.alias(k) for k, v in (base | values).items())
            return df.select("pair_id", F.lit(block).alias("block"), key.cast("string").alias("key"), status.alias("status"), *columns)

        def ident(p: str) -> Column:
            return F.col(f"{p}_id")

        def label(p: str) -> Column:
            return F.col(f"{p}_label")

        moves = r.operations.where("type = 'MOVE'").select("pair_id", F.col("source_refs")[0].alias("s"), F.col("operation_id").alias("move_id"), F.col("confidence").alias("move_confidence"))
        sure = r.sure.where(F.col("state") == CONFIRMED).join(s, ["pair_id", "s"]).join(moves, ["pair_id", "s"], "left").join(t, ["pair_id", "t"], "left").where("s_parent_ref is not null")
        state = revision_state(F.col("s_have"), F.col("t_known"))
        least = self.policy.confirmed_match_threshold if self.policy else 0.9
        status = F.when(F.col("move_id").isNotNull(), "WRONG_PARENT").when(state == "STALE", "SOURCE_UPDATED").when(F.col("confidence") >= least, "CONFIRMED_MATCH").otherwise("PROBABLE_MATCH")
        out = [
            rows(
                sure, 0, F.concat("s", F.lit("|"), "t"), status, source_ref=F.col("s"), locale_ref=F.col("t"), source_id=ident("s"), locale_id=ident("t"), source_label=label("s"), locale_label=label("t"),
                match_ids=F.array("match_id"), operation_ids=F.when(F.col("move_id").isNotNull(), F.array("move_id")).otherwise(none), match_confidence=F.col("confidence"),
                operation_confidence=F.col("move_confidence"), translation_state=state, message=lookup(MESSAGES, status),
            )
        ]
        amb = r.open_nodes.where(F.col("side") == SOURCE).select("pair_id", F.col("node_ref").alias("s"), "confidence").join(s, ["pair_id", "s"])
        out.append(rows(amb, 1, F.col("s"), F.lit("AMBIGUOUS_MATCH"), source_ref=F.col("s"), source_id=ident("s"), source_label=label("s"), match_confidence=F.col("confidence"), message=F.lit(MESSAGES["AMBIGUOUS_MATCH"])))
        order = r.operations.where("type = 'REORDER'")
        out.append(rows(order, 2, F.col("operation_id"), F.lit("WRONG_ORDER"), source_ref=F.col("source_refs")[0], match_ids=F.col("match_ids"), operation_ids=F.array("operation_id"), operation_confidence=F.col("confidence"), message=F.lit(MESSAGES["WRONG_ORDER"])))
        for type_, end, side, default in (("DELETE", "s", s, "MISSING_IN_LOCALE"), ("INSERT", "t", t, "EXTRA_IN_LOCALE")):
            refs = F.col("source_refs" if end == "s" else "target_refs")[0]
            ops = r.operations.where(F.col("type") == type_).withColumn(end, refs).join(side, ["pair_id", end], "left")
            exempt = self._exemption(type_, F.coalesce(f"{end}_node_type", F.lit("")))
            names = ("source", "locale")[end == "t"]
            ends = {f"{names}_ref": F.col(end), f"{names}_id": ident(end), f"{names}_label": label(end)}
            out.append(rows(ops, 3, F.concat(F.lit(f"{type_}|"), "operation_id"), F.when(exempt.isNotNull(), "EXEMPT_LOCALE_VARIATION").otherwise(default), operation_ids=F.array("operation_id"), operation_confidence=F.col("confidence"), exemption=exempt, message=F.concat(F.lit("policy-exempt variation ("), exempt, F.lit(")")), **ends))
        dup = r.diagnostics.where("code = 'DUPLICATE_PERSISTENT_ID'")
        out.append(rows(dup, 4, F.format_string("%09d", F.col("ordinal")), F.lit("IDENTIFIER_CONFLICT"), message=F.lit(MESSAGES["IDENTIFIER_CONFLICT"])))
        return kept(reduce(DataFrame.unionByName, out))  # ranges are drawn from it before it is dealt

    def _clean(self, found: DataFrame) -> DataFrame:
        """``found`` without contradictions: an ambiguous or unresolved node is never also missing or extra. Other issues need no join for it."""
        r = self.result
        clean = [found.where(~F.col("status").isin("MISSING_IN_LOCALE", "EXTRA_IN_LOCALE"))]
        for end, side, kind, name, status in (("s", SOURCE, "UNRESOLVED_SOURCE", "source_ref", "MISSING_IN_LOCALE"), ("t", TARGET, "UNRESOLVED_TARGET", "locale_ref", "EXTRA_IN_LOCALE")):
            open_ = r.open_nodes.where(F.col("side") == side).select("pair_id", F.col("node_ref").alias(name))
            open_ = open_.union(r.positions.where(F.col("kind") == kind).select("pair_id", end)).distinct()
            clean.append(found.where(F.col("status") == status).join(open_, ["pair_id", name], "left_anti"))
        return reduce(DataFrame.unionByName, clean)

    def _judged(self, found: DataFrame) -> DataFrame:
        """``found`` with severity, action and ``repair``, whether it calls for one."""
        repair = F.col("status").isin(*REPAIR) & F.col("exemption").isNull()
        return found.withColumn("severity", lookup(SEVERITY, F.col("status"))).withColumn("action", lookup(ACTION, F.col("status"), "NONE")).withColumn("repair", repair)

    @property
    def findings(self) -> DataFrame:
        """``issues`` without numbers, for what only counts or lists them: nothing is put in order. With ``repair``."""
        return self._judged(self._clean(self._found)).drop("block", "key")

    @cached_property
    def issues(self) -> DataFrame:
        """One row per finding, with ids in order before contradictions are dropped."""
        every = numbered(self._found, ["pair_id"], ["block", "key"], "issue_no").withColumn("issue_id", F.concat(F.lit("issue-"), F.col("issue_no").cast("string")))
        every = self._judged(every.drop("block", "key"))
        # what can be a contradiction calls for a repair, so the others are only read where they are used
        counted = numbered(kept(self._clean(every.where("repair"))), ["pair_id"], ["issue_no"], "repair_no")
        counted = counted.unionByName(every.where("not repair"), allowMissingColumns=True)
        repair = F.col("repair")
        base = F.least(F.coalesce("match_confidence", F.lit(1.0)), F.coalesce("operation_confidence", F.lit(1.0)))
        counted = counted.withColumn("recommendation_id", F.when(repair, F.concat(F.lit("repair-"), F.col("repair_no").cast("string"))))
        counted = counted.withColumn("repair_confidence", F.when(repair, F.round(base * REPAIR_FACTOR, 6)))
        return counted.withColumn("auto_fix_eligible", F.lit(False)).drop("repair", "repair_no")

    def issue_match_ids(self) -> DataFrame:
        """pair_id, issue_id, match_ids of the issues about ambiguous sources and orders, on request: ``issues`` has none of
        the k of a source with k like it, and of a class of siblings only the first and the last."""
        return self._ambiguous_ids(self.issues.select("pair_id", "issue_id", "status", "source_ref")).select("pair_id", "issue_id", "match_ids").unionByName(self._order_ids())

    def issues_in_full(self) -> DataFrame:
        """``issues`` with all match ids of each, on request. Lists of ambiguous sources are made last, so that no row that holds one is shuffled."""
        open_ = F.col("status") == "AMBIGUOUS_MATCH"
        rest = self.issues.where(~open_).join(self._order_ids().withColumnRenamed("match_ids", "_ids"), ["pair_id", "issue_id"], "left")
        rest = rest.withColumn("match_ids", F.coalesce("_ids", "match_ids")).drop("_ids")
        return rest.unionByName(self._ambiguous_ids(self.issues.drop("match_ids")))

    def _ambiguous_ids(self, issues: DataFrame) -> DataFrame:
        rows = issues.where("status = 'AMBIGUOUS_MATCH'")
        s = F.col("source_ref")
        ids = F.transform("refs", lambda t: F.concat(F.lit("m:"), s, F.lit("->"), t)).alias("match_ids")
        return self.result.graph.targets(rows.withColumnRenamed("source_ref", "s")).withColumnRenamed("s", "source_ref").select(*issues.columns, ids)

    def _order_ids(self) -> DataFrame:
        orders = self.result.siblings.groupBy("pair_id", "operation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s", "match_id"))), lambda x: x["match_id"]).alias("match_ids"))
        wrong = self.issues.where("status = 'WRONG_ORDER'").select("pair_id", "issue_id", F.col("operation_ids")[0].alias("operation_id"))
        return wrong.join(orders, ["pair_id", "operation_id"]).drop("operation_id")

    @cached_property
    def recommendations(self) -> DataFrame:
        rows = self.issues.where("recommendation_id is not null").withColumn("operation_id", F.get("operation_ids", F.lit(0)))
        parents = self.result.operations.where("from_parent is not null").select("pair_id", "operation_id", "from_parent")
        rows = rows.join(parents, ["pair_id", "operation_id"], "left")
        op = lookup(REPAIR, F.col("status"))

        def lists(table: dict[str, tuple[str, ...]]) -> Column:
            return F.element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), op)

        return rows.select(
            "pair_id", "recommendation_id", op.alias("operation"), F.lit(self.authoritative_side).alias("authoritative_side"),
            F.lit("LOCALE" if self.authoritative_side == "SOURCE" else "SOURCE").alias("target_side"), "issue_id", F.col("operation_ids").alias("source_operation_ids"),
            F.coalesce("locale_ref", "source_ref").alias("target_node_ref"), F.col("from_parent").alias("destination_parent_ref"), F.lit(None).cast("string").alias("after_sibling_ref"),
            "repair_confidence", lookup(CHANGES, op).alias("change"), lists(PRECONDITIONS).alias("preconditions"), lists(POSTCONDITIONS).alias("postconditions"), F.lit(False).alias("executable"),
        )

    @cached_property
    def status_counts(self) -> DataFrame:
        return self.findings.groupBy("pair_id", "status", "action").agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def summary(self) -> DataFrame:
        """Counts per pair: each category of node, direct issues, suppressed effects, unresolved regions."""
        n = lambda *statuses: F.count_if(F.col("status").isin(*statuses))
        rows = self.findings.groupBy("pair_id").agg(
            n("CONFIRMED_MATCH").alias("confirmed"), n("PROBABLE_MATCH").alias("probable"), n("AMBIGUOUS_MATCH").alias("ambiguous"), n("MISSING_IN_LOCALE").alias("missing"),
            n("EXTRA_IN_LOCALE").alias("extra"), n("WRONG_PARENT", "WRONG_ORDER", "LOCALE_DIVERGED").alias("structurally_divergent"), n("EXEMPT_LOCALE_VARIATION").alias("exempt"),
            F.count(F.lit(1)).alias("direct_issue_count"), F.bool_or(F.col("severity") == "ERROR").alias("has_errors"),
        )
        effects = self.result.effects.groupBy("pair_id").agg(F.count(F.lit(1)).alias("suppressed_effect_count"))
        open_ = self.result.regions.groupBy("pair_id").agg(F.count_if("unresolved").alias("unresolved_region_count"))
        zero = F.lit(0).cast("long")
        rows = open_.join(rows, "pair_id", "left").join(effects, "pair_id", "left")
        counts = [c for c in rows.columns if c not in ("pair_id", "has_errors")]
        return rows.select("pair_id", *(F.coalesce(c, zero).alias(c) for c in counts), F.coalesce("has_errors", F.lit(False)).alias("has_errors"))

    def summary_by(self) -> DataFrame:
        """Counts by locale, status and severity with all subtotals."""
        return self.findings.withColumn("locale", F.lit(self.locale)).cube("locale", "status", "severity").agg(F.count(F.lit(1)).alias("n"))


def record_decisions(decisions: DataFrame, issues: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Decisions (pair_id, decision_id, issue_id, disposition, replacement, decided_at) with outcome: RECORDED and the
    issue's status, or why not. Of equal ids the first by time counts; ids in ``known`` are refused."""
    status = issues.select("pair_id", "issue_id", F.col("status").alias("original_status"))
    rows = decisions.join(status, ["pair_id", "issue_id"], "left")
    again = Window.partitionBy("decision_id").orderBy("decided_at", "pair_id", "issue_id")
    rows = rows.withColumn("rn", F.row_number().over(again))
    if known is not None:
        rows = rows.join(known.select("decision_id").distinct().withColumn("old", F.lit(True)), "decision_id", "left")
    else:
        rows = rows.withColumn("old", F.lit(None).cast("boolean"))
    override = F.col("disposition") == "OVERRIDE"
    bad = override & (F.col("replacement").isNull() | (F.col("replacement") == F.col("original_status")))
    outcome = F.when(F.col("original_status").isNull(), "COMPARISON_REJECTED").when(F.col("old") | (F.col("rn") > 1), "REPOSITORY_ERROR").when(bad, "COMPARISON_REJECTED").otherwise("RECORDED")
    return rows.withColumn("outcome", outcome).withColumn("replacement", F.when(override, F.col("replacement"))).drop("rn", "old")


def price(summary: DataFrame, rates: DataFrame) -> DataFrame:
    """pair_id, hours and price from category counts and ``rates`` (category, hours, price per item); money is decimal."""
    categories = ("confirmed", "probable", "ambiguous", "missing", "extra", "structurally_divergent", "exempt")
    stack = F.stack(F.lit(len(categories)), *(x for c in categories for x in (F.lit(c), F.col(c)))).alias("category", "n")
    rows = summary.select("pair_id", stack).where("n > 0").join(rates, "category")
    money = F.sum(F.col("n").cast("decimal(18,0)") * F.col("price").cast("decimal(18,6)")).cast("decimal(38,6)")
    return rows.groupBy("pair_id").agg(F.round(F.sum(F.col("n") * F.col("hours")), 6).alias("hours"), money.alias("price"))
