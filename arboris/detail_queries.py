"""More queries of the engine's own operators: whole rows of issues, repairs and reports, jobs, repositories, decisions, labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from arboris.functions import lcs

from arboris.operators import causal, validate
from arboris.plans import evaluate, jobs, localization, report
from arboris.plans.engine import reconcile
from arboris.profiles import BUNDLES, Limits
from arboris.queries import _AFFECTED, _MOVED, _OPS, DITA, ORACLE_SQL, _localized, _moved, _operations_sql, _ops_query, _result, _sql, _table, query
from arboris.sources import generators
from arboris.sources.edges import from_edges, order_trees
from arboris.storage import kept

# --- issues, repairs and reports as whole rows -----------------------------------

# issues of every kind with the numbers that they get; what is fixed per status is written out here
_DETAILS = """
raw AS (
    SELECT c.pair_id, 0 AS block, c.s || '|' || c.t AS key, CASE WHEN v.s IS NOT NULL THEN 'WRONG_PARENT' WHEN c.confidence >= 0.9e0 THEN 'CONFIRMED_MATCH' ELSE 'PROBABLE_MATCH' END AS status, c.s AS source_ref, c.t AS locale_ref,
           x.pid AS source_id, y.pid AS locale_id, 'm:' || c.s || '->' || c.t AS match_ids, CASE WHEN v.s IS NOT NULL THEN 'op:move:' || c.s || '->' || c.t END AS root, c.confidence AS mc, v.confidence AS oc, 'UNKNOWN' AS translation_state
    FROM cf c JOIN sn x ON x.pair_id = c.pair_id AND x.node_ref = c.s JOIN tn y ON y.pair_id = c.pair_id AND y.node_ref = c.t LEFT JOIN mv v ON v.pair_id = c.pair_id AND v.s = c.s WHERE x.parent_ref IS NOT NULL
    UNION ALL SELECT a.pair_id, 1, a.s, 'AMBIGUOUS_MATCH', a.s, NULL, any_value(x.pid), NULL, string_agg('m:' || a.s || '->' || a.t, ';' ORDER BY a.t), NULL, max(a.confidence), NULL, NULL
        FROM am a JOIN sn x ON x.pair_id = a.pair_id AND x.node_ref = a.s GROUP BY a.pair_id, a.s
    UNION ALL SELECT r.pair_id, 2, 'op:reorder:' || r.sp, 'WRONG_ORDER', min_by(al.s, al.pos), NULL, NULL, NULL, string_agg('m:' || al.s || '->' || al.t, ';' ORDER BY al.pos, al.s), 'op:reorder:' || r.sp, NULL, 1e0, NULL
        FROM reg r JOIN al ON al.pair_id = r.pair_id AND al.sp = r.sp AND al.tp = r.tp WHERE r.order_changed GROUP BY r.pair_id, r.sp
    UNION ALL SELECT o.pair_id, 3, 'DELETE|' || o.operation_id, 'MISSING_IN_LOCALE', o.s, NULL, x.pid, NULL, '', o.operation_id, NULL, o.confidence, NULL FROM ops o JOIN sn x ON x.pair_id = o.pair_id AND x.node_ref = o.s WHERE o.type = 'DELETE'
    UNION ALL SELECT o.pair_id, 3, 'INSERT|' || o.operation_id, 'EXTRA_IN_LOCALE', NULL, o.t, NULL, y.pid, '', o.operation_id, NULL, o.confidence, NULL FROM ops o JOIN tn y ON y.pair_id = o.pair_id AND y.node_ref = o.t WHERE o.type = 'INSERT'),
fixed(status, severity, action, repair, change, pre, post) AS (VALUES
    ('CONFIRMED_MATCH', 'INFO', 'NONE', NULL, NULL, NULL, NULL), ('PROBABLE_MATCH', 'INFO', 'NONE', NULL, NULL, NULL, NULL), ('AMBIGUOUS_MATCH', 'WARNING', 'REVIEW', NULL, NULL, NULL, NULL),
    ('MISSING_IN_LOCALE', 'ERROR', 'ADD_OR_TRANSLATE', 'ADD_NODE', 'CONTAINMENT', 'INPUT_FINGERPRINT_UNCHANGED;DESTINATION_PARENT_EXISTS;SOURCE_NODE_AVAILABLE;DOMAIN_RULES_PASS', 'REQUIRED_NODE_PRESENT_IN_LOCALE;XML_REMAINS_SCHEMA_VALID'),
    ('EXTRA_IN_LOCALE', 'WARNING', 'REVIEW_OR_REMOVE', 'REMOVE_NODE', 'CONTAINMENT', 'INPUT_FINGERPRINT_UNCHANGED;TARGET_NODE_EXISTS;DOMAIN_RULES_PASS', 'EXTRA_NODE_REMOVED_FROM_LOCALE;XML_REMAINS_SCHEMA_VALID'),
    ('WRONG_PARENT', 'ERROR', 'RELINK_OR_MOVE', 'MOVE_NODE', 'CONTAINMENT', 'INPUT_FINGERPRINT_UNCHANGED;TARGET_NODE_EXISTS;DESTINATION_PARENT_EXISTS;DOMAIN_RULES_PASS', 'TARGET_PARENT_MATCHES_AUTHORITATIVE_PARENT;XML_REMAINS_SCHEMA_VALID'),
    ('WRONG_ORDER', 'WARNING', 'REORDER', 'REORDER_NODES', 'ORDER', 'INPUT_FINGERPRINT_UNCHANGED;MATCHED_SIBLINGS_EXIST;DOMAIN_RULES_PASS', 'SIBLING_ORDER_MATCHES_AUTHORITATIVE;XML_REMAINS_SCHEMA_VALID')),
no AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY block, key) AS issue_no FROM raw),
det AS (SELECT no.*, 'issue-' || issue_no AS issue_id, severity, action, repair, change, pre, post FROM no JOIN fixed USING (status)
    WHERE NOT (status = 'MISSING_IN_LOCALE' AND (pair_id, source_ref) IN (SELECT (pair_id, s) FROM am)) AND NOT (status = 'EXTRA_IN_LOCALE' AND (pair_id, locale_ref) IN (SELECT (pair_id, t) FROM am))),
rep AS (SELECT *, 'repair-' || row_number() OVER (PARTITION BY pair_id ORDER BY issue_no) AS recommendation_id, round(0.9e0 * least(coalesce(mc, 1e0), coalesce(oc, 1e0)), 6) AS rc FROM det WHERE repair IS NOT NULL)"""


@query(_sql("SELECT pair_id, issue_id, status, severity, action, source_ref, locale_ref, source_id, locale_id, match_ids, root AS operation_id, mc AS match_confidence, oc AS operation_confidence, translation_state FROM det", _OPS, _DETAILS))
def loc_issue_details(spark, sf_dir):
    return _localized(spark, sf_dir).issues_in_full().select(
        "pair_id", "issue_id", "status", "severity", "action", "source_ref", "locale_ref", "source_id", "locale_id", F.array_join("match_ids", ";").alias("match_ids"),
        F.get("operation_ids", F.lit(0)).alias("operation_id"), "match_confidence", "operation_confidence", "translation_state",
    )


@query(_sql("""SELECT rep.pair_id, recommendation_id, repair AS operation, issue_id, 'SOURCE' AS authoritative_side, 'LOCALE' AS target_side, coalesce(locale_ref, source_ref) AS target_node_ref,
    mv.expected AS destination_parent_ref, rc AS repair_confidence, change, pre AS preconditions, post AS postconditions, false AS executable
    FROM rep LEFT JOIN mv ON mv.pair_id = rep.pair_id AND mv.s = rep.source_ref AND rep.status = 'WRONG_PARENT'""", _OPS, _DETAILS))
def loc_recommendation_details(spark, sf_dir):
    return _localized(spark, sf_dir).recommendations.select(
        "pair_id", "recommendation_id", "operation", "issue_id", "authoritative_side", "target_side", "target_node_ref", "destination_parent_ref", "repair_confidence", "change",
        F.array_join("preconditions", ";").alias("preconditions"), F.array_join("postconditions", ";").alias("postconditions"), "executable",
    )


# null columns have a type of their own in each engine, so that they come as whether they are null
_REPORT = """
SELECT det.pair_id AS job_id, issue_id AS result_id, source_id AS source_node_id, locale_id AS locale_node_id, source_ref AS source_path, locale_ref AS locale_path, coalesce(x.node_type, y.node_type) AS node_type,
    CASE block WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'CONFIRMED' END AS match_status, status AS localization_status, upper(split_part(root, ':', 2)) AS operation, mc AS match_confidence, oc AS operation_confidence,
    rep.rc AS repair_confidence, root AS root_operation_id, false AS is_suppressed, NULL AS suppression_rule, CASE WHEN e.operation_id IS NULL THEN 0 ELSE 1 END::BIGINT AS suppressed_effect_count, action AS recommended_action
    FROM det LEFT JOIN (SELECT pair_id, issue_no, rc FROM rep) rep USING (pair_id, issue_no) LEFT JOIN sn x ON x.pair_id = det.pair_id AND x.node_ref = det.source_ref LEFT JOIN tn y ON y.pair_id = det.pair_id AND y.node_ref = det.locale_ref
    LEFT JOIN eff e ON e.pair_id = det.pair_id AND e.operation_id = det.root
UNION ALL SELECT pair_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'SUPPRESSED_EFFECT', CASE type WHEN 'MOVE' THEN 'DESCENDANT_PATH_CHANGED' ELSE 'DOWNSTREAM_POSITION_CHANGED' END, NULL, confidence, NULL, operation_id, true,
    CASE type WHEN 'INSERT' THEN 'insert-downstream-position-v1' WHEN 'DELETE' THEN 'delete-downstream-position-v1' WHEN 'MOVE' THEN 'move-descendant-path-v1' ELSE 'reorder-position-v1' END, 0, NULL FROM eff"""
_REPORT_COLUMNS = (
    "job_id", "source_node_id", "locale_node_id", "source_path", "locale_path", "node_type", "match_status", "localization_status", "operation", "match_confidence", "operation_confidence", "repair_confidence",
    "root_operation_id", "is_suppressed", "suppression_rule", "suppressed_effect_count", "recommended_action",
)


@query(_sql(_REPORT, _OPS, _AFFECTED, _DETAILS))
def report_details(spark, sf_dir):
    rows = report.report_rows(_localized(spark, sf_dir))
    return rows.select(*_REPORT_COLUMNS, F.when(~F.col("is_suppressed"), F.col("result_id")).alias("result_id"))


@query(_sql("""SELECT pair_id AS job_id, issue_id AS result_id, coalesce(source_id, '') AS source_node_id, coalesce(locale_ref, '') AS locale_path, coalesce(CASE WHEN mc = 1 THEN '1.0' ELSE rtrim(printf('%.6f', mc), '0') END, '') AS match_confidence,
    'false' AS is_suppressed, '' AS source_label FROM det""", _OPS, _DETAILS))
def report_csv_cells(spark, sf_dir):
    rows = report.csv_cells(report.report_rows(_localized(spark, sf_dir), suppressed=False))
    return rows.select("job_id", "result_id", "source_node_id", "locale_path", "match_confidence", "is_suppressed", "source_label")


@query(_sql("""SELECT pair_id AS job_id, issue_id, CASE status WHEN 'CONFIRMED_MATCH' THEN 'OK' WHEN 'PROBABLE_MATCH' THEN '~' WHEN 'AMBIGUOUS_MATCH' THEN '?' WHEN 'MISSING_IN_LOCALE' THEN '-' WHEN 'EXTRA_IN_LOCALE' THEN '+'
    WHEN 'WRONG_PARENT' THEN '!' ELSE '><' END AS status_symbol, status = 'AMBIGUOUS_MATCH' AS needs_review FROM det""", _OPS, _DETAILS))
def report_symbols(spark, sf_dir):
    return report.issue_rows(_localized(spark, sf_dir)).select("job_id", "issue_id", "status_symbol", "needs_review")


@query(_sql("SELECT pair_id AS job_id, '1.0.0' AS schema_version, 'fr-FR' AS locale, 'SOURCE' AS authoritative_side, true AS complete, 'dita-map-v1' AS bundle FROM (SELECT DISTINCT pair_id FROM nodes)", upto=1))
def report_heads(spark, sf_dir):
    head = report.head_rows(_localized(spark, sf_dir))
    return head.select("job_id", "schema_version", "locale", "authoritative_side", "complete", F.col("versions.bundle").alias("bundle"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN '—' ELSE CASE WHEN l_linenumber >= 7 THEN 'high' WHEN l_linenumber >= 4 THEN 'medium' ELSE 'low' END || printf(' (%.2f)', l_linenumber / 8e0) END AS text FROM lineitem")
def confidence_texts(spark, sf_dir):
    c = F.when(F.col("l_quantity") >= 10, F.col("l_linenumber") / F.lit(8.0))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", report.confidence_text(c).alias("text"))


@query(_sql("SELECT pair_id, coalesce(round(avg(confidence) FILTER (type <> 'MATCH'), 6), 1e0) AS confidence FROM ops GROUP BY pair_id", _OPS))
def causal_confidence(spark, sf_dir):
    return _result(spark, sf_dir).explanations.where("explanation_id = 'explanation-primary'").select("pair_id", "confidence")


_ops_query("ops_reorder_other_parent_unordered", "'REORDER'", _operations_sql(unordered="customer"), alignment__order_by_type=(("customer", False),))

# customers of nations divisible by 5 come in reverse, so that one of them stays in place; all others do
ORACLE_SQL["lcs_align"] = """WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL)
    SELECT CAST(k AS VARCHAR) AS pair_id, 'ALIGN' AS kind, CASE WHEN k % 5 = 0 THEN 1 ELSE n END AS n FROM n
    UNION ALL SELECT CAST(k AS VARCHAR), kind, n - 1 FROM n, (VALUES ('LEFT_ONLY'), ('RIGHT_ONLY')) x(kind) WHERE k % 5 = 0 AND n > 1"""



# customers of a nation by key against the same by balance: the length of the longest ascending chain says how many stay
@query("""WITH RECURSIVE c AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS b FROM customer),
    v AS (SELECT k, list(b ORDER BY a) AS vs, count(*) AS n FROM c GROUP BY k),
    r AS (SELECT k, vs, n, 0 AS i, CAST([] AS BIGINT[]) AS best FROM v
        UNION ALL SELECT k, vs, n, i + 1, list_append(best, 1 + coalesce(list_max(list_transform(list_filter(range(1, i + 1), lambda j: vs[j] < vs[i + 1]), lambda j: best[j])), 0)) FROM r WHERE i < n)
    SELECT CAST(k AS VARCHAR) AS pair_id, list_max(best) AS n_align, n - list_max(best) AS n_left_only, n - list_max(best) AS n_right_only FROM r WHERE i = n""")
def lcs_shuffled(spark, sf_dir):
    def refs(*order):
        return F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda x: x["c_custkey"])

    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").cast("string").alias("pair_id")).agg(refs("c_custkey").alias("l"), refs("c_acctbal", "c_custkey").alias("r"))
    steps = rows.select("pair_id", F.explode(lcs.lcs_align("l", "r")["kind"]).alias("kind"))
    return steps.groupBy("pair_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in (lcs.ALIGN, lcs.LEFT_ONLY, lcs.RIGHT_ONLY)))


# --- messages, evidence, fingerprints, limits ----------------------------------------


@query(_sql("""SELECT pair_id, issue_id, status, CASE status WHEN 'WRONG_PARENT' THEN 'the node''s counterpart stands under a parent that doesn''t correspond'
    WHEN 'WRONG_ORDER' THEN 'counterparts under corresponding parents come in another order' WHEN 'AMBIGUOUS_MATCH' THEN 'several nodes of the locale could correspond; someone has to choose' END AS message FROM det""", _OPS, _DETAILS))
def loc_messages(spark, sf_dir):
    return _localized(spark, sf_dir).issues.select("pair_id", "issue_id", "status", "message")


@query(_sql("""SELECT job_id, result_id, string_agg(DISTINCT code, ';' ORDER BY code) AS evidence_codes, false AS auto_fix_eligible FROM (
    SELECT im.pair_id AS job_id, im.issue_id AS result_id, unnest([CASE WHEN x.pid = y.pid THEN 'PERSISTENT_ID' END, CASE WHEN x.sig = y.sig THEN 'SEMANTIC_SIGNATURE' END, CASE WHEN x.cs = y.cs THEN 'WEIGHTED_SIMILARITY' END]) AS code
    FROM im JOIN sn x ON x.pair_id = im.pair_id AND x.node_ref = im.s JOIN tn y ON y.pair_id = im.pair_id AND y.node_ref = im.t) GROUP BY ALL""", _OPS, _DETAILS, """
im AS (SELECT pair_id, issue_id, source_ref AS s, locale_ref AS t FROM det WHERE block = 0 UNION ALL SELECT d.pair_id, d.issue_id, a.s, a.t FROM det d JOIN am a ON a.pair_id = d.pair_id AND a.s = d.source_ref WHERE d.block = 1
    UNION ALL SELECT d.pair_id, d.issue_id, al.s, al.t FROM det d JOIN al ON al.pair_id = d.pair_id AND 'op:reorder:' || al.sp = d.root WHERE d.block = 2)"""))
def report_evidence(spark, sf_dir):
    rows = report.report_rows(_localized(spark, sf_dir), suppressed=False).where("size(evidence_codes) > 0")
    return rows.select("job_id", "result_id", F.array_join(F.array_sort("evidence_codes"), ";").alias("evidence_codes"), "auto_fix_eligible")


@query(_sql("SELECT pair_id, 'effect-' || row_number() OVER (PARTITION BY pair_id ORDER BY type, operation_id) AS effect_id, operation_id AS root_operation_id FROM eff", _OPS, _AFFECTED))
def effect_numbers(spark, sf_dir):
    return _result(spark, sf_dir).effects.select("pair_id", "effect_id", "root_operation_id")


_SIZES = """
sz AS (SELECT pair_id, count(*) FILTER (side = 'S') AS a, count(*) FILTER (side = 'T') AS b, (SELECT count(*) FROM m WHERE m.pair_id = nodes.pair_id) AS c,
    (SELECT count(*) FROM cf WHERE cf.pair_id = nodes.pair_id) AS d, (SELECT count(*) FROM ops WHERE ops.pair_id = nodes.pair_id) AS e, (SELECT count(*) FROM reg WHERE reg.pair_id = nodes.pair_id) AS f,
    (SELECT count(*) FROM eff WHERE eff.pair_id = nodes.pair_id) AS g FROM nodes GROUP BY pair_id)"""


@query(_sql("""SELECT pair_id, sha256('{"source_nodes":' || a || ',"target_nodes":' || b || ',"candidates":' || c || ',"matches":' || d || ',"operations":' || e || '}') AS fingerprint FROM sz""", _OPS, _AFFECTED, _SIZES))
def performance_fingerprints(spark, sf_dir):
    return _result(spark, sf_dir).performance_fingerprint()


@query(_sql("""SELECT pair_id, sha256('{"source_nodes":' || a || ',"target_nodes":' || b || ',"stages":[{"stage":"ALIGNMENT","candidates":0,"results":' || f || '},{"stage":"CLASSIFICATION","candidates":0,"results":' || e
    || '},{"stage":"MATCHING","candidates":' || c || ',"results":' || d || '},{"stage":"SUPPRESSION","candidates":0,"results":' || g || '}]}') AS fingerprint FROM sz""", _OPS, _AFFECTED, _SIZES))
def metrics_fingerprints(spark, sf_dir):
    return _result(spark, sf_dir).metrics_fingerprint()


@query(_sql("""SELECT p.pair_id, coalesce(n, 0) <= 20 AS complete FROM (SELECT DISTINCT pair_id FROM nodes) p LEFT JOIN (SELECT pair_id, count(*) AS n FROM (
    SELECT s.pair_id, s.node_ref AS s, t.node_ref AS t FROM sfree s JOIN tfree t ON s.pair_id = t.pair_id AND s.sig = t.sig AND s.node_type = t.node_type
    UNION SELECT s.pair_id, s.node_ref, t.node_ref FROM sfree s JOIN tfree t ON s.pair_id = t.pair_id AND s.pid = t.pid AND s.node_type = t.node_type) GROUP BY pair_id) USING (pair_id)""", upto=3))
def limits_status(spark, sf_dir):
    return _result(spark, sf_dir, limits=Limits(max_candidates=20)).status


# --- causes ----------------------------------------------------------------------------


@query(_sql("SELECT DISTINCT v.pair_id, 'op:move:' || v.s || '->' || v.t AS cause, o.operation_id AS effect FROM mv v JOIN below b ON b.pair_id = v.pair_id AND b.top = v.s JOIN ops o ON o.pair_id = b.pair_id AND o.s = b.node_ref AND o.type IN ('UPDATE', 'DELETE', 'MOVE')", _OPS, _AFFECTED, nodes=_MOVED))
def causal_links(spark, sf_dir):
    return _moved(spark, sf_dir).causal_links()


# customers in fours: each leads to the next, every third four back to its first, and an even four to the next one
@query("""WITH RECURSIVE c AS (SELECT c_custkey AS k, (c_custkey - 1) // 4 AS g, (c_custkey - 1) % 4 AS i FROM customer),
    e AS (SELECT CAST(x.g // 2 % 25 AS VARCHAR) AS pair_id, x.k AS a, y.k AS b FROM c x JOIN c y ON (y.k = x.k + 1 AND x.i < 3) OR (y.k = x.k - 3 AND x.i = 3 AND x.g % 3 = 0) OR (y.k = x.k + 4 AND x.i = 0 AND x.g % 2 = 0)),
    r AS (SELECT * FROM e UNION SELECT r.pair_id, r.a, e.b FROM r JOIN e ON e.pair_id = r.pair_id AND e.a = r.b)
    SELECT x.pair_id, x.a AS node, min(y.a) AS circle FROM r x JOIN r y ON y.pair_id = x.pair_id AND y.a = x.b AND y.b = x.a GROUP BY x.pair_id, x.a""")
def causal_circles(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    g, i = F.floor((F.col("a") - 1) / 4), (F.col("a") - 1) % 4
    to = F.array(F.when(i < 3, F.col("a") + 1), F.when((i == 3) & (g % 3 == 0), F.col("a") - 3), F.when((i == 0) & (g % 2 == 0), F.col("a") + 4))
    edges = c.select((F.floor(g / 2) % 25).cast("string").alias("pair_id"), "a", F.explode(to).alias("b")).where("b is not null")
    return causal.circles(edges.join(c.select(F.col("a").alias("b")), "b", "left_semi"))


# --- labels and revisions -----------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS k, CAST(c_nationkey AS VARCHAR) AS job_id, c_name, c_mktsegment AS seg FROM customer)
    SELECT job_id, 'c' || k AS source_path, CASE WHEN k % 3 = 0 THEN seg WHEN k % 2 = 0 THEN c_name END AS source_label, CASE WHEN k % 5 <> 0 THEN c_name END AS locale_label,
        CASE WHEN k % 7 NOT IN (0, 1) AND k % 7 = 2 THEN 'SOURCE_UPDATED' ELSE 'CONFIRMED_MATCH' END AS localization_status,
        CASE WHEN k % 7 <> 0 THEN 'v' || k END AS source_revision, CASE WHEN k % 7 = 2 THEN 'v0' WHEN k % 7 <> 1 THEN 'v' || k END AS locale_revision FROM c""")
def report_labels_and_revisions(spark, sf_dir):
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    revision = F.concat(F.lit("v"), key)
    plan = {
        "S": (F.create_map(F.lit("navtitle"), F.when(k % 3 == 0, F.col("c_mktsegment")), F.lit("title"), F.when(k % 2 == 0, F.col("c_name"))), F.create_map(F.lit("revision"), F.when(k % 7 != 0, revision))),
        "T": (F.create_map(F.lit("label"), F.when(k % 5 != 0, F.col("c_name"))), F.create_map(F.lit("source-revision"), F.when(k % 7 == 2, F.lit("v0")).when(k % 7 != 1, revision))),
    }
    out = []
    for side, (content, structural) in plan.items():
        known = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
        nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
        base = _table(spark, sf_dir, "customer").select(
            F.col("c_nationkey").cast("string").alias("pair_id"), F.lit(side).alias("side"), F.concat(F.lit("c"), key).alias("node_ref"), F.lit("topicref").alias("node_type"), nation.alias("parent_ref"),
            k.alias("child_pos"), F.create_map(F.lit("id"), F.concat(F.lit("i"), key)).alias("identity"), known(content).alias("content"), known(structural).alias("structural"),
        )
        none = F.create_map().cast("map<string,string>")
        root = base.select("pair_id", "side", F.col("parent_ref").alias("node_ref")).distinct().select(
            "*", F.lit("map").alias("node_type"), F.lit(None).cast("string").alias("parent_ref"), F.lit(0).cast("long").alias("child_pos"), F.create_map(F.lit("id"), F.lit("root")).alias("identity"), none.alias("content"), none.alias("structural")
        )
        out += [base, root]
    nodes = from_edges(out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]))
    rows = report.report_rows(localization.Localization(reconcile(nodes, DITA), "fr-FR"), suppressed=False)
    return rows.select("job_id", "source_path", "source_label", "locale_label", "localization_status", "source_revision", "locale_revision")


# --- repositories, jobs, decisions ---------------------------------------------------


@query("""WITH objects AS (SELECT CAST(o_custkey AS VARCHAR) AS object_id, CAST(o_orderkey AS VARCHAR) AS revision, 'o' || o_orderkey AS content FROM orders UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, c_name FROM customer WHERE c_custkey % 4 = 0),
    latest AS (SELECT object_id, coalesce(max(content) FILTER (revision IS NULL), max_by(content, revision)) AS content FROM objects GROUP BY object_id),
    refs AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE (SELECT CAST(min(o_orderkey) AS VARCHAR) FROM orders WHERE o_custkey = c_custkey) END AS rev FROM customer)
    SELECT id AS pair_id, a.content AS source_content, CASE WHEN rev IS NULL THEN a.content ELSE b.content END AS locale_content, CASE WHEN a.content IS NULL OR CASE WHEN rev IS NULL THEN a.content ELSE b.content END IS NULL THEN 'CCMS_READ_FAILED' END AS error_code
    FROM refs LEFT JOIN latest a ON a.object_id = id LEFT JOIN objects b ON b.object_id = id AND b.revision = rev""")
def repository_reads(spark, sf_dir):
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    text = lambda c: F.col(c).cast("string")
    objects = orders.select(text("o_custkey").alias("object_id"), text("o_orderkey").alias("revision"), F.concat(F.lit("o"), text("o_orderkey")).alias("content"))
    objects = objects.unionByName(customer.where("c_custkey % 4 = 0").select(text("c_custkey").alias("object_id"), F.lit(None).cast("string").alias("revision"), F.col("c_name").alias("content")))
    first = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").cast("string").alias("first"))
    none = F.lit(None).cast("string")
    refs = customer.join(first, "c_custkey", "left").select(
        text("c_custkey").alias("pair_id"), F.lit("generic-json-v1").alias("profile_id"), text("c_custkey").alias("source_object"), none.alias("source_revision"),
        text("c_custkey").alias("locale_object"), F.when(F.col("c_custkey") % 5 == 0, F.lit("none")).otherwise(F.col("first")).alias("locale_revision"),
    )
    return jobs.from_repository(refs, objects).select("pair_id", "source_content", "locale_content", "error_code")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS title, CAST(c_nationkey AS VARCHAR) AS contact, 2::INTEGER AS n FROM customer")
def metadata_renamed(spark, sf_dir):
    nation = F.col("c_nationkey").cast("string")
    even = F.create_map(F.lit("Title"), "c_name", F.lit("phone"), nation, F.lit("other"), "c_name", F.lit("HEAD"), "c_mktsegment")
    odd = F.create_map(F.lit("HEAD"), "c_mktsegment", F.lit("phone"), nation, F.lit("Title"), "c_name")
    got = jobs.metadata(F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd), {"Title": "title", "HEAD": "title", "phone": "contact"})
    rows = _table(spark, sf_dir, "customer").select("c_custkey", got.alias("m"))
    return rows.select("c_custkey", F.col("m").getItem("title").alias("title"), F.col("m").getItem("contact").alias("contact"), F.size("m").alias("n"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS pair_id, CASE WHEN c_custkey % 11 = 0 THEN 'REJECTED' WHEN c_custkey % 7 = 0 THEN 'REJECTED' WHEN c_custkey % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS state,
    CASE WHEN c_custkey % 11 = 0 THEN 'UNSUPPORTED_CONTRACT' WHEN c_custkey % 7 = 0 THEN 'INVALID_INPUT' WHEN c_custkey % 5 = 0 THEN 'RESOURCE_LIMIT_EXCEEDED' END AS error_code, 'corr-' || c_custkey AS correlation_id FROM customer""")
def jobs_states(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.concat(F.lit('{"name": "'), name, F.lit('"}'))
    many = F.concat(F.lit("["), F.array_join(F.array_repeat(text, 12), ","), F.lit("]"))
    requests = _table(spark, sf_dir, "customer").select(
        k.cast("string").alias("pair_id"), F.when(k % 11 == 0, F.lit("no-such-v1")).otherwise(F.lit("generic-json-v1")).alias("profile_id"), text.alias("source_content"),
        F.when(k % 7 == 0, F.lit('{"name"')).when(k % 5 == 0, many).otherwise(text).alias("locale_content"),
    )
    bundle = BUNDLES["generic-json-v1"]
    batch = jobs.compare(requests, "fr-FR", bundles={"generic-json-v1": bundle.with_(limits__max_node_count=30)})
    return batch.jobs.select("pair_id", "state", "error_code", "correlation_id")


@query("""WITH d AS (SELECT CAST(o_custkey AS VARCHAR) AS pair_id, 'd' || (o_orderkey // 3) AS decision_id, 'issue-' || o_orderkey AS issue_id, CASE WHEN o_orderkey % 2 = 0 THEN 'OVERRIDE' ELSE 'ACCEPT' END AS disposition,
        CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 'MISSING_IN_LOCALE' ELSE 'CONFIRMED_MATCH' END AS replacement, o_orderkey AS decided_at, CASE WHEN o_orderkey % 5 <> 0 THEN 'MISSING_IN_LOCALE' END AS original_status FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY decided_at) AS rn, decision_id IN (SELECT 'd' || o_orderkey FROM orders WHERE o_orderkey % 10 = 1) AS old FROM d)
    SELECT pair_id, decision_id, issue_id, original_status, CASE WHEN disposition = 'OVERRIDE' THEN replacement END AS replacement, CASE WHEN original_status IS NULL THEN 'COMPARISON_REJECTED' WHEN old OR rn > 1 THEN 'REPOSITORY_ERROR'
        WHEN disposition = 'OVERRIDE' AND (replacement IS NULL OR replacement = original_status) THEN 'COMPARISON_REJECTED' ELSE 'RECORDED' END AS outcome FROM r""")
def decisions_recorded(spark, sf_dir):
    orders, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    pair, issue = F.col("o_custkey").cast("string").alias("pair_id"), F.concat(F.lit("issue-"), k.cast("string")).alias("issue_id")
    issues = orders.where(k % 5 != 0).select(pair, issue, F.lit("MISSING_IN_LOCALE").alias("status"))
    named = lambda c: F.concat(F.lit("d"), c.cast("string")).alias("decision_id")
    replacement = F.when(k % 8 == 0, F.lit(None).cast("string")).when(k % 6 == 0, F.lit("MISSING_IN_LOCALE")).otherwise(F.lit("CONFIRMED_MATCH"))
    made = orders.select(pair, named(F.floor(k / 3)), issue, F.when(k % 2 == 0, "OVERRIDE").otherwise("ACCEPT").alias("disposition"), replacement.alias("replacement"), k.alias("decided_at"))
    rows = localization.record_decisions(made, issues, orders.where(k % 10 == 1).select(named(k)))
    return rows.select("pair_id", "decision_id", "issue_id", "original_status", "replacement", "outcome")


# --- labelled cases, generated trees, invariants --------------------------------------


@query(_sql("""SELECT kind, true_positives, false_positives, false_negatives, CASE WHEN true_positives + false_positives = 0 THEN 1e0 ELSE true_positives / (true_positives + false_positives) END AS precision,
        CASE WHEN true_positives + false_negatives = 0 THEN 1e0 ELSE true_positives / (true_positives + false_negatives) END AS recall FROM (
        SELECT kind, count(*) FILTER (f AND e) AS true_positives, count(*) FILTER (f AND NOT e) AS false_positives, count(*) FILTER (e AND NOT f) AS false_negatives FROM (
            SELECT 'MATCH' AS kind, bool_or(f) AS f, bool_or(e) AS e FROM (SELECT pair_id, s, t, true AS f, false AS e FROM cf UNION ALL SELECT s.pair_id, s.node_ref, t.node_ref, false, true FROM sn s JOIN tn t ON s.pair_id = t.pair_id AND s.node_ref = t.node_ref) GROUP BY pair_id, s, t
            UNION ALL SELECT type, bool_or(f), bool_or(e) FROM (SELECT pair_id, operation_id, type, true AS f, false AS e FROM ops WHERE type <> 'MATCH'
                UNION ALL SELECT pair_id, 'op:delete:' || node_ref, 'DELETE', false, true FROM sn WHERE node_type = 'order' AND child_pos % 11 = 0
                UNION ALL SELECT pair_id, 'op:insert:' || node_ref, 'INSERT', false, true FROM tn WHERE node_ref LIKE 'x%') GROUP BY pair_id, operation_id, type) GROUP BY kind)""", _OPS))
def quality_labelled(spark, sf_dir):
    rows = order_trees(spark, sf_dir).select("pair_id", "side", "node_ref", "node_type", "child_pos")
    s, t = rows.where("side = 'S'"), rows.where("side = 'T'")
    same = s.select("pair_id", F.col("node_ref").alias("s"), F.col("node_ref").alias("t")).join(t.select("pair_id", F.col("node_ref").alias("t")), ["pair_id", "t"])
    gone = s.where("node_type = 'order' and child_pos % 11 = 0").select("pair_id", F.concat(F.lit("op:delete:"), "node_ref").alias("operation_id"), F.lit("DELETE").alias("type"))
    new = t.where(F.col("node_ref").startswith("x")).select("pair_id", F.concat(F.lit("op:insert:"), "node_ref").alias("operation_id"), F.lit("INSERT").alias("type"))
    return evaluate.quality(_result(spark, sf_dir), same, gone.unionByName(new))


@query(_sql("SELECT x.pair_id, coalesce(a.n, 0) / x.n AS ambiguity_rate FROM (SELECT pair_id, count(*) AS n FROM sn WHERE parent_ref IS NOT NULL GROUP BY ALL) x LEFT JOIN (SELECT pair_id, count(DISTINCT s) AS n FROM am GROUP BY ALL) a USING (pair_id)", upto=3))
def quality_ambiguity_rate(spark, sf_dir):
    return evaluate.ambiguity_rate(_result(spark, sf_dir))


@query(_sql("SELECT o.pair_id, coalesce(d, 0) / (coalesce(d, 0) + n) AS cascade_reduction FROM (SELECT pair_id, count(*) AS n FROM ops WHERE type <> 'MATCH' GROUP BY ALL) o LEFT JOIN (SELECT pair_id, sum(n)::BIGINT AS d FROM eff GROUP BY ALL) USING (pair_id)", _OPS, _AFFECTED))
def quality_cascade_reduction(spark, sf_dir):
    return evaluate.cascade_reduction(_result(spark, sf_dir))


@query("""SELECT pair_id, kind, count(*) AS n FROM (
    SELECT 'high-edit' AS pair_id, CASE WHEN i % 2 = 0 THEN 'MATCH' ELSE 'DELETE' END AS kind FROM range(1000) x(i) UNION ALL SELECT 'high-edit', 'INSERT' FROM range(250) UNION ALL SELECT 'wide', 'MATCH' FROM range(500)
    UNION ALL SELECT 'deep', 'MATCH' FROM range(80) UNION ALL SELECT 'repetitive', 'AMBIGUOUS' FROM range(30 * 30)) GROUP BY ALL""")
def generated_trees(spark, sf_dir):
    shapes = [(generators.wide, 500), (generators.deep, 80), (generators.repetitive, 30)]
    nodes = generators.high_edit(spark, 1000)
    for make, n in shapes:
        nodes = nodes.unionByName(make(spark, n, side="S")).unionByName(make(spark, n, side="T"))
    r = reconcile(kept(nodes), DITA)
    kinds = r.operations.groupBy("pair_id", F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(r.graph.counts().where("state = 'AMBIGUOUS'").withColumnRenamed("state", "kind"))


# S: a root whose list of children is wrong in places; T: customers of a nation in a ring, without a root
_BAD_TREES = """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS pair_id, c_custkey AS k, 'c' || c_custkey AS ref, 'n' || c_nationkey AS root FROM customer),
v AS (SELECT pair_id, 'S' AS side, 'MISSING_FROM_PARENT_CHILDREN' AS code, ref AS node_ref FROM c WHERE k % 7 = 0 UNION ALL SELECT pair_id, 'S', 'DANGLING_CHILD_REF', 'g' || k FROM c WHERE k % 11 = 0
    UNION ALL SELECT pair_id, 'S', 'PARENT_CHILD_DISAGREEMENT', root FROM c WHERE k % 13 = 0 UNION ALL SELECT pair_id, 'T', 'CONTAINMENT_CYCLE', ref FROM c UNION ALL SELECT pair_id, 'T', 'MISSING_ROOT', min(ref) FROM c GROUP BY pair_id
    UNION ALL SELECT 'dup-' || pair_id, 'S', 'DUPLICATE_NODE_REF', ref FROM c WHERE k % 17 = 0)"""


def _bad_trees(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = _table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("pair_id"), k, F.concat(F.lit("c"), text).alias("ref"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("root"),
        F.concat(F.lit("c"), F.coalesce(F.lead(k).over(w), F.first(k).over(whole)).cast("string")).alias("next"), F.concat(F.lit("c"), F.coalesce(F.lag(k).over(w), F.last(k).over(whole)).cast("string")).alias("last"), text.alias("text"),
    )
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")

    def rows(df: DataFrame, side: str, ref, parent, kids) -> DataFrame:
        return df.select("pair_id", F.lit(side).alias("side"), ref.alias("node_ref"), parent.alias("parent_ref"), kids.alias("child_refs"))

    lists = c.groupBy("pair_id", "root").agg(F.concat(F.collect_list(F.when(k % 7 != 0, F.col("ref"))), F.collect_list(F.when(k % 11 == 0, F.concat(F.lit("g"), "text")))).alias("kids"), F.collect_list("ref").alias("every"))
    dup = c.withColumn("pair_id", F.concat(F.lit("dup-"), "pair_id"))
    twice = dup.unionByName(dup.where(k % 17 == 0))
    out = rows(c, "S", F.col("ref"), F.col("root"), F.when(k % 13 == 0, F.array("root")).otherwise(none)).unionByName(rows(lists, "S", F.col("root"), null, F.col("kids")))
    out = out.unionByName(rows(c, "T", F.col("ref"), F.col("next"), F.array("last")))
    return out.unionByName(rows(twice, "S", F.col("ref"), F.col("root"), none)).unionByName(rows(lists.withColumn("pair_id", F.concat(F.lit("dup-"), "pair_id")), "S", F.col("root"), null, F.col("every")))


@query(_BAD_TREES + " SELECT pair_id, side, code, node_ref FROM v")
def tree_child_lists(spark, sf_dir):
    return validate.tree_violations(kept(_bad_trees(spark, sf_dir)))


@query(_BAD_TREES + """, o AS (SELECT *, CASE code WHEN 'CONTAINMENT_CYCLE' THEN 1 WHEN 'DANGLING_CHILD_REF' THEN 2 WHEN 'PARENT_CHILD_DISAGREEMENT' THEN 3 WHEN 'MISSING_FROM_PARENT_CHILDREN' THEN 5 WHEN 'MISSING_ROOT' THEN 7 ELSE 8 END AS place FROM v)
    SELECT pair_id, side, code, node_ref, n FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY place, node_ref) AS rn, count(*) OVER (PARTITION BY pair_id, side) AS n FROM o) WHERE rn = 1""")
def tree_first_violations(spark, sf_dir):
    return validate.first_violations(validate.tree_violations(kept(_bad_trees(spark, sf_dir))))
