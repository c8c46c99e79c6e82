"""Queries of the engine's own operators over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arboris.functions import lcs
from arboris.functions.text import collapsed, key_list, link, plain
from arboris.operators import evidence, match, normalize, validate
from arboris.plans import jobs, localization, report
from arboris.plans.engine import Result, reconcile
from arboris.plans.localization import LocaleRule, Localization, Policy
from arboris.profiles import BUNDLES, Limits, Normalization
from arboris.schema import NODES
from arboris.sources import documents
from arboris.sources.edges import order_trees
from arboris.storage import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DITA = BUNDLES["dita-map-v1"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_shared: dict[tuple, Result] = {}


def forget() -> None:
    """Let the next query make its stages itself, as ``bench.py`` wants."""
    _shared.clear()


def _result(spark: SparkSession, sf_dir: str, **parts) -> Result:
    """The order trees reconciled; queries of one session over the same tables share its stages."""
    key = (spark.sparkContext.applicationId, sf_dir, repr(sorted(parts.items())))
    if key not in _shared:
        _shared[key] = reconcile(kept(order_trees(spark, sf_dir)), DITA.with_(**parts))
    return _shared[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the same chain in SQL ------------------------------------------------------

_V = "VARCHAR"
_NODES = f"""
nxt AS (SELECT *, coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER w) AS nk FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
o AS (SELECT *, CAST(o_orderkey AS {_V}) AS ok, CAST(c_nationkey AS {_V}) AS nat, CASE WHEN o_orderkey % 10 <> 0 THEN 'O' || o_orderkey END AS oid,
             o_orderstatus || '|' || o_orderpriority AS txt FROM orders JOIN nxt ON o_custkey = c_custkey),
nodes AS (
    SELECT CAST(n_nationkey AS {_V}) AS pair_id, side, 'n' || n_nationkey AS node_ref, 'nation' AS node_type, CAST(NULL AS {_V}) AS parent_ref, CAST(0 AS BIGINT) AS child_pos,
           'N' || n_nationkey AS pid, CAST(NULL AS {_V}) AS content FROM nation, (VALUES ('S'), ('T')) x(side)
    UNION ALL SELECT CAST(c_nationkey AS {_V}), side, 'c' || c_custkey, 'customer', 'n' || c_nationkey, CASE WHEN side = 'T' AND c_nationkey % 5 = 0 THEN -c_custkey ELSE c_custkey END,
           'C' || c_custkey, c_mktsegment FROM customer, (VALUES ('S'), ('T')) x(side)
    UNION ALL SELECT nat, 'S', 'o' || ok, 'order', 'c' || o_custkey, o_orderkey, oid, txt FROM o
    UNION ALL SELECT nat, 'T', 'o' || ok, 'order', 'c' || CASE WHEN o_orderkey % 13 = 0 THEN nk ELSE o_custkey END, o_orderkey, oid, txt || CASE WHEN o_orderkey % 7 = 0 THEN '*' ELSE '' END FROM o WHERE o_orderkey % 11 <> 0
    UNION ALL SELECT nat, 'T', 'x' || ok, 'order', 'c' || o_custkey, o_orderkey, 'X' || ok, txt FROM o WHERE o_orderkey % 17 = 0)"""
_EVIDENCE = """
kids AS (SELECT pair_id, side, parent_ref AS node_ref, string_agg(node_type, ',' ORDER BY child_pos, node_ref) AS cs FROM nodes WHERE parent_ref IS NOT NULL GROUP BY ALL),
ev AS (SELECT n.*, node_type || '|' || coalesce(content, chr(1)) AS sig, coalesce(cs, '') AS cs,
              CASE WHEN pid IS NOT NULL THEN count(*) OVER (PARTITION BY n.pair_id, n.side, pid) END AS dup FROM nodes n LEFT JOIN kids USING (pair_id, side, node_ref)),
sn AS (SELECT * FROM ev WHERE side = 'S'), tn AS (SELECT * FROM ev WHERE side = 'T')"""
_SCORE = """round((CASE WHEN s.pid = t.pid THEN 0.5e0 ELSE 0e0 END + CASE WHEN s.sig = t.sig THEN 0.4e0 ELSE 0e0 END + CASE WHEN s.cs = t.cs THEN 0.2e0 ELSE 0e0 END)
    / (CASE WHEN s.pid IS NOT NULL OR t.pid IS NOT NULL THEN 0.5e0 ELSE 0e0 END + 0.4e0 + 0.2e0), 6)"""
_MATCH = f"""
auth AS (SELECT s.pair_id, s.node_ref AS s, t.node_ref AS t, {_SCORE} AS score, CASE WHEN s.node_type = t.node_type THEN 'CONFIRMED' ELSE 'REJECTED' END AS state
         FROM sn s JOIN tn t ON s.pair_id = t.pair_id AND s.pid = t.pid WHERE s.dup = 1 AND t.dup = 1),
sfree AS (SELECT * FROM sn WHERE (pair_id, node_ref) NOT IN (SELECT (pair_id, s) FROM auth WHERE state = 'CONFIRMED')),
tfree AS (SELECT * FROM tn WHERE (pair_id, node_ref) NOT IN (SELECT (pair_id, t) FROM auth WHERE state = 'CONFIRMED')),
cand AS (SELECT * FROM (
             SELECT s.pair_id, s.node_ref AS s, t.node_ref AS t, {_SCORE} AS score FROM sfree s JOIN tfree t ON s.pair_id = t.pair_id AND s.sig = t.sig AND s.node_type = t.node_type
             UNION SELECT s.pair_id, s.node_ref, t.node_ref, {_SCORE} FROM sfree s JOIN tfree t ON s.pair_id = t.pair_id AND s.pid = t.pid AND s.node_type = t.node_type) WHERE score >= 0.4e0),
rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id, s ORDER BY score DESC, t) AS rn, max(score) OVER (PARTITION BY pair_id, s) AS top FROM cand),
rk2 AS (SELECT *, max(CASE WHEN rn = 2 THEN score END) OVER (PARTITION BY pair_id, s) AS second FROM rk),
pick AS (SELECT *, max(score) OVER (PARTITION BY pair_id, t) AS best FROM rk WHERE rn = 1 AND score >= 0.6e0),
near AS (SELECT *, count(*) OVER (PARTITION BY pair_id, t) AS n FROM pick WHERE best - score <= 0.05e0),
amb AS (SELECT pair_id, s, t, score FROM rk2 WHERE top >= 0.6e0 AND top - second <= 0.05e0 AND top - score <= 0.05e0 UNION SELECT pair_id, s, t, score FROM near WHERE n >= 2),
sure AS (SELECT * EXCLUDE k FROM (SELECT pair_id, s, t, score, row_number() OVER (PARTITION BY pair_id, t ORDER BY score DESC, s) AS k FROM rk
         WHERE rn = 1 AND score >= 0.6e0 AND (pair_id, s) NOT IN (SELECT (pair_id, s) FROM amb) AND (pair_id, t) NOT IN (SELECT (pair_id, t) FROM amb)) WHERE k = 1),
m AS (SELECT pair_id, s, t, state, score, CASE WHEN state = 'CONFIRMED' THEN 1e0 ELSE score END AS confidence FROM auth
      UNION ALL SELECT pair_id, s, t, 'AMBIGUOUS', score, score FROM amb UNION ALL SELECT pair_id, s, t, 'CONFIRMED', score, score FROM sure),
cf AS (SELECT * FROM m WHERE state = 'CONFIRMED'), am AS (SELECT * FROM m WHERE state = 'AMBIGUOUS')"""
_ALIGN = """
roots AS (SELECT a.pair_id, a.node_ref AS sp, b.node_ref AS tp FROM sn a JOIN tn b ON a.pair_id = b.pair_id WHERE a.parent_ref IS NULL AND b.parent_ref IS NULL),
pp AS (SELECT * FROM roots UNION SELECT pair_id, s, t FROM cf),
al AS (SELECT pp.*, c.s, c.t, c.confidence, x.child_pos AS pos, y.child_pos AS t_pos FROM cf c JOIN sn x ON x.pair_id = c.pair_id AND x.node_ref = c.s JOIN tn y ON y.pair_id = c.pair_id AND y.node_ref = c.t
       JOIN pp ON pp.pair_id = c.pair_id AND pp.sp = x.parent_ref AND pp.tp = y.parent_ref),
ams AS (SELECT DISTINCT pair_id, s FROM am WHERE (pair_id, s) NOT IN (SELECT (pair_id, s) FROM cf)),
amt AS (SELECT DISTINCT pair_id, t FROM am WHERE (pair_id, t) NOT IN (SELECT (pair_id, t) FROM cf)),
ls AS (SELECT pp.*, x.node_ref AS s, x.child_pos AS pos, CASE WHEN a.s IS NULL THEN 'SOURCE_ONLY' ELSE 'UNRESOLVED_SOURCE' END AS kind FROM pp JOIN sn x ON x.pair_id = pp.pair_id AND x.parent_ref = pp.sp
       LEFT JOIN ams a ON a.pair_id = pp.pair_id AND a.s = x.node_ref WHERE (pp.pair_id, pp.sp, pp.tp, x.node_ref) NOT IN (SELECT (pair_id, sp, tp, s) FROM al)),
lt AS (SELECT pp.*, y.node_ref AS t, y.child_pos AS pos, CASE WHEN a.t IS NULL THEN 'TARGET_ONLY' ELSE 'UNRESOLVED_TARGET' END AS kind FROM pp JOIN tn y ON y.pair_id = pp.pair_id AND y.parent_ref = pp.tp
       LEFT JOIN amt a ON a.pair_id = pp.pair_id AND a.t = y.node_ref WHERE (pp.pair_id, pp.sp, pp.tp, y.node_ref) NOT IN (SELECT (pair_id, sp, tp, t) FROM al)),
pos AS (SELECT pair_id, sp, tp, 0 AS block, pos, 'ALIGNED' AS kind, s, t, confidence, t_pos FROM al UNION ALL SELECT pair_id, sp, tp, 1, pos, kind, s, NULL, NULL, NULL FROM ls
        UNION ALL SELECT pair_id, sp, tp, 2, pos, kind, NULL, t, NULL, NULL FROM lt),
mv0 AS (SELECT pair_id, sp, tp, bool_or(a <> b) AS moved FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, sp, tp ORDER BY pos, s) AS a, row_number() OVER (PARTITION BY pair_id, sp, tp ORDER BY t_pos, t) AS b FROM al) GROUP BY ALL),
reg AS (SELECT pp.*, coalesce(moved, false) AS order_changed, coalesce(u, 0) > 0 AS unresolved, coalesce(n, 0) AS n_aligned, coalesce(u, 0) AS n_unresolved FROM pp LEFT JOIN mv0 USING (pair_id, sp, tp)
        LEFT JOIN (SELECT pair_id, sp, tp, count(*) FILTER (kind = 'ALIGNED') AS n, count(*) FILTER (kind LIKE 'UNRESOLVED%') AS u FROM pos GROUP BY ALL) USING (pair_id, sp, tp))"""


def _operations_sql(policy: str = "SUPPRESS_AMBIGUOUS_NODES", move: float = 0.75, unordered: str | None = None) -> str:
    rule = {"SUPPRESS_AMBIGUOUS_NODES": "kind NOT LIKE 'UNRESOLVED%'", "EMIT_ALL": "true"}.get(policy, "kind NOT LIKE 'UNRESOLVED%' AND (pair_id, sp, tp) NOT IN (SELECT (pair_id, sp, tp) FROM reg WHERE unresolved)")
    order = "" if unordered is None else f" AND (pair_id, sp) NOT IN (SELECT (pair_id, node_ref) FROM sn WHERE node_type = '{unordered}')"
    return f"""
mv AS (SELECT c.pair_id, c.s, c.t, x.parent_ref AS sp, y.parent_ref AS tp, e.t AS expected, c.confidence FROM cf c JOIN sn x ON x.pair_id = c.pair_id AND x.node_ref = c.s JOIN tn y ON y.pair_id = c.pair_id AND y.node_ref = c.t
       LEFT JOIN cf e ON e.pair_id = c.pair_id AND e.s = x.parent_ref
       WHERE x.parent_ref IS NOT NULL AND y.parent_ref IS NOT NULL AND (c.pair_id, x.parent_ref, y.parent_ref) NOT IN (SELECT (pair_id, sp, tp) FROM pp) AND c.confidence >= {move}e0),
ops AS (
    SELECT al.pair_id, 'op:' || CASE WHEN a.content IS NOT DISTINCT FROM b.content THEN 'match' ELSE 'update' END || ':' || s || '->' || t AS operation_id,
           CASE WHEN a.content IS NOT DISTINCT FROM b.content THEN 'MATCH' ELSE 'UPDATE' END AS type, s, t, confidence FROM al JOIN sn a ON a.pair_id = al.pair_id AND a.node_ref = s JOIN tn b ON b.pair_id = al.pair_id AND b.node_ref = t
    UNION ALL SELECT pair_id, 'op:delete:' || s, 'DELETE', s, NULL, 1e0 FROM pos WHERE s IS NOT NULL AND t IS NULL AND {rule} AND (pair_id, s) NOT IN (SELECT (pair_id, s) FROM mv)
    UNION ALL SELECT pair_id, 'op:insert:' || t, 'INSERT', NULL, t, 1e0 FROM pos WHERE t IS NOT NULL AND s IS NULL AND {rule} AND (pair_id, t) NOT IN (SELECT (pair_id, t) FROM mv)
    UNION ALL SELECT pair_id, 'op:move:' || s || '->' || t, 'MOVE', s, t, confidence FROM mv
    UNION ALL SELECT pair_id, 'op:reorder:' || sp, 'REORDER', sp, NULL, 1e0 FROM reg WHERE order_changed{order})"""


_AFFECTED = """
desc0 AS (SELECT pair_id, s AS top, s AS node_ref FROM mv), 
below AS (SELECT d.pair_id, d.top, n.node_ref FROM desc0 d JOIN sn n ON n.pair_id = d.pair_id AND n.parent_ref = d.top),
reach AS (
    SELECT DISTINCT o.pair_id, o.operation_id, o.type, o.confidence, a.t AS node_ref FROM ops o JOIN pos p ON p.pair_id = o.pair_id AND p.t = o.t JOIN al a ON a.pair_id = p.pair_id AND a.sp = p.sp AND a.tp = p.tp WHERE o.type = 'INSERT'
    UNION SELECT DISTINCT o.pair_id, o.operation_id, o.type, o.confidence, a.t FROM ops o JOIN pos p ON p.pair_id = o.pair_id AND p.s = o.s JOIN al a ON a.pair_id = p.pair_id AND a.sp = p.sp AND a.tp = p.tp WHERE o.type = 'DELETE'
    UNION SELECT DISTINCT o.pair_id, o.operation_id, o.type, o.confidence, a.t FROM ops o JOIN al r ON r.pair_id = o.pair_id AND r.sp = o.s JOIN al a ON a.pair_id = o.pair_id AND (a.sp = r.sp OR a.sp = r.s) WHERE o.type = 'REORDER'
    UNION SELECT DISTINCT o.pair_id, o.operation_id, o.type, o.confidence, b.node_ref FROM ops o JOIN below b ON b.pair_id = o.pair_id AND b.top = o.s WHERE o.type = 'MOVE'),
eff AS (SELECT pair_id, operation_id, type, confidence, count(*) AS n, min(node_ref) AS first_ref, max(node_ref) AS last_ref FROM reach
        WHERE confidence >= CASE type WHEN 'MOVE' THEN 0.7e0 ELSE 0.6e0 END GROUP BY ALL)"""


def _issues_sql(exempt: str | None = None, least: float = 0.9) -> str:
    ex = "false" if exempt is None else f"n.node_type = '{exempt}'"
    return f"""
iss AS (
    SELECT c.pair_id, CASE WHEN v.s IS NOT NULL THEN 'WRONG_PARENT' WHEN c.confidence >= {least}e0 THEN 'CONFIRMED_MATCH' ELSE 'PROBABLE_MATCH' END AS status, c.s AS source_ref, c.t AS locale_ref, c.confidence AS mc, v.confidence AS oc
    FROM cf c JOIN sn x ON x.pair_id = c.pair_id AND x.node_ref = c.s LEFT JOIN mv v ON v.pair_id = c.pair_id AND v.s = c.s WHERE x.parent_ref IS NOT NULL
    UNION ALL SELECT pair_id, 'AMBIGUOUS_MATCH', s, NULL, max(confidence), NULL FROM am GROUP BY pair_id, s
    UNION ALL SELECT r.pair_id, 'WRONG_ORDER', (SELECT min_by(al.s, al.pos) FROM al WHERE al.pair_id = r.pair_id AND al.sp = r.sp AND al.tp = r.tp), NULL, NULL, 1e0 FROM reg r WHERE order_changed
    UNION ALL SELECT o.pair_id, 'MISSING_IN_LOCALE', o.s, NULL, NULL, o.confidence FROM ops o WHERE type = 'DELETE' AND (o.pair_id, o.s) NOT IN (SELECT (pair_id, s) FROM am)
    UNION ALL SELECT o.pair_id, CASE WHEN {ex} THEN 'EXEMPT_LOCALE_VARIATION' ELSE 'EXTRA_IN_LOCALE' END, NULL, o.t, NULL, o.confidence FROM ops o JOIN tn n ON n.pair_id = o.pair_id AND n.node_ref = o.t WHERE type = 'INSERT'
        AND ({ex} OR (o.pair_id, o.t) NOT IN (SELECT (pair_id, t) FROM am)))"""


def _sql(select: str, *more: str, upto: int = 4, nodes: str = _NODES) -> str:
    return "WITH " + ",".join([nodes, _EVIDENCE, _MATCH, _ALIGN][:upto] + list(more)) + "\n" + select


_OPS = _operations_sql()

# --- scans and evidence ---------------------------------------------------------


@query(_sql("SELECT pair_id, side, node_type, count(*) AS n, count(pid) AS n_ids, min(child_pos) AS first_pos, max(child_pos) AS last_pos FROM nodes GROUP BY ALL", upto=1))
def node_scan_counts(spark, sf_dir):
    rows = order_trees(spark, sf_dir).groupBy("pair_id", "side", "node_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.col("identity").getItem("id")).alias("n_ids"), F.min("child_pos").alias("first_pos"), F.max("child_pos").alias("last_pos"))


@query(_sql("SELECT pair_id, side, node_ref, cs AS child_signature FROM ev WHERE node_type <> 'order'", upto=2))
def child_signature(spark, sf_dir):
    nodes = _result(spark, sf_dir).nodes.where("node_type <> 'order'").select("pair_id", "side", "node_ref")
    rows = nodes.join(evidence.child_types(_result(spark, sf_dir).raw), ["pair_id", "side", "node_ref"], "left")
    return rows.select("pair_id", "side", "node_ref", F.coalesce("types", F.lit("")).alias("child_signature"))


@query(_sql("""SELECT pair_id, side, parent_ref AS node_ref, count(*) || ':' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS digest
    FROM (SELECT *, md5(row_number() OVER (PARTITION BY pair_id, side, parent_ref ORDER BY child_pos, node_ref) || ':' || node_type) AS h FROM nodes WHERE parent_ref IS NOT NULL) GROUP BY ALL""", upto=1))
def child_digests(spark, sf_dir):
    return _result(spark, sf_dir).nodes.where("child_signature <> ''").select("pair_id", "side", "node_ref", F.col("child_signature").alias("digest"))


@query(_sql("SELECT 'x' AS pair_id, 'S' AS side, c_mktsegment AS persistent_id, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1", upto=1))
def persistent_id_dups(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.lit("x").alias("pair_id"), F.lit("S").alias("side"), F.col("c_custkey").cast("string").alias("node_ref"), F.lit("c").alias("node_type"), F.lit(None).cast("string").alias("parent_ref"), F.col("c_custkey").alias("child_pos"), F.create_map(F.lit("guid"), "c_mktsegment").alias("identity"))
    from arboris.sources.edges import from_edges

    return evidence.duplicate_ids(evidence.extract(from_edges(rows)))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS label FROM customer")
def label_first_present(spark, sf_dir):
    k = F.col("c_custkey") % 3
    rows = _table(spark, sf_dir, "customer").withColumn("identity", F.create_map(F.lit("label"), F.when(k == 0, F.concat(F.lit("s:"), "c_name")).otherwise(F.lit("s:"))))
    # an empty label in identity hides the one in content, so the next key counts
    rows = rows.withColumn("content", F.create_map(F.lit("label"), F.lit("s:hidden"), F.lit("title"), F.when(k == 1, F.concat(F.lit("s:"), "c_mktsegment")).otherwise(F.lit("i:7"))))
    return rows.select("c_custkey", evidence.first_present(evidence.LABEL_KEYS).alias("label"))


@query(_sql("SELECT pair_id, side, node_type, count(*) AS n FROM ev GROUP BY pair_id, side, node_type, sig", upto=2))
def signature_groups(spark, sf_dir):
    return _result(spark, sf_dir).nodes.groupBy("pair_id", "side", "node_type", "signature").agg(F.count(F.lit(1)).alias("n")).drop("signature")


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS text FROM documents")
def normalize_whitespace(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", collapsed(F.col("text")).alias("text"))


@query("SELECT CAST(doc_id AS VARCHAR) AS node_ref, 'text' AS key, 'COLLAPSED' AS rule FROM documents WHERE text <> trim(regexp_replace(text, '\\s+', ' ', 'g')) UNION ALL SELECT CAST(doc_id AS VARCHAR), 'class', 'DROPPED' FROM documents")
def normalize_trace(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.lit("d").alias("pair_id"), F.lit("S").alias("side"), F.col("doc_id").cast("string").alias("node_ref"), F.create_map(F.lit("text"), F.concat(F.lit("s:"), "text"), F.lit("class"), F.lit("s:x")).alias("content"))
    return normalize.trace(rows, Normalization(nonsemantic_metadata_keys=("class",))).select("node_ref", "key", "rule")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_keys, regexp_replace('././' || doc_id || '.dita', '^(\\./)+', '') AS href FROM documents")
def dita_links_and_keys(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(key_list(F.col("text"))).cast("long").alias("n_keys"), link(F.concat(F.lit(" ././"), F.col("doc_id").cast("string"), F.lit(".dita"))).alias("href"))


# --- matching -------------------------------------------------------------------


@query(_sql("SELECT pair_id, s, t, score FROM auth WHERE state = 'CONFIRMED'", upto=3))
def match_authoritative(spark, sf_dir):
    return match.authoritative(_result(spark, sf_dir).nodes, DITA.matching).where("state = 'CONFIRMED'").select("pair_id", "s", "t", "score")


_FLIPPED = _NODES.replace("nodes AS (", "nodes0 AS (") + ",\nnodes AS (SELECT * REPLACE (CASE WHEN side = 'T' AND node_type = 'order' AND child_pos % 19 = 0 THEN 'invoice' ELSE node_type END AS node_type) FROM nodes0)"


def _flipped(spark, sf_dir) -> Result:
    rows = order_trees(spark, sf_dir)
    flip = (F.col("side") == "T") & (F.col("node_type") == "order") & (F.col("child_pos") % 19 == 0)
    return reconcile(rows.withColumn("node_type", F.when(flip, "invoice").otherwise(F.col("node_type"))), DITA)


@query(_sql("SELECT pair_id, s, t, state, score, confidence FROM m WHERE state = 'REJECTED'", upto=3, nodes=_FLIPPED))
def match_rejected_type_conflict(spark, sf_dir):
    return _flipped(spark, sf_dir).sure.where("state = 'REJECTED'").select("pair_id", "s", "t", "state", "score", "confidence")


@query(_sql("SELECT pair_id, s, t, score FROM cand", upto=3))
def match_candidates_scored(spark, sf_dir):
    r = _result(spark, sf_dir)
    auth = match.authoritative(r.nodes, DITA.matching)
    return match.candidates(r.nodes, auth.where("state = 'CONFIRMED'"), DITA.matching, kept).select("pair_id", "s", "t", "score")


@query(_sql("SELECT pair_id, s, t, score FROM am", upto=3))
def match_ambiguous(spark, sf_dir):
    return _result(spark, sf_dir).graph.ambiguous_edges().select("pair_id", "s", "t", "score")


@query(_sql("""SELECT pair_id, 'm:' || s || '->' || t AS match_id, string_agg('m:' || os || '->' || ot, ';' ORDER BY os, ot) AS alternatives FROM (
    SELECT a.pair_id, a.s, a.t, b.s AS os, b.t AS ot FROM am a JOIN am b ON a.pair_id = b.pair_id AND a.s = b.s WHERE a.t <> b.t
    UNION SELECT a.pair_id, a.s, a.t, b.s, b.t FROM am a JOIN am b ON a.pair_id = b.pair_id AND a.t = b.t WHERE a.s <> b.s) GROUP BY pair_id, s, t""", upto=3))
def match_ambiguous_alternatives(spark, sf_dir):
    out = _result(spark, sf_dir).graph.alternatives()
    return out.select("pair_id", "match_id", F.array_join("alternatives", ";").alias("alternatives"))


@query(_sql("SELECT pair_id, s, t, score FROM sure", upto=3))
def match_confirmed_similarity(spark, sf_dir):
    return _result(spark, sf_dir).sure.where("state = 'CONFIRMED' and confidence < 1.0 or state = 'CONFIRMED' and not array_contains(evidence, 'PERSISTENT_ID')").select("pair_id", "s", "t", "score")


@query(_sql("SELECT pair_id, state, count(*) AS n, count(DISTINCT s) AS n_s, count(DISTINCT t) AS n_t FROM m GROUP BY ALL", upto=3))
def match_state_counts(spark, sf_dir):
    r = _result(spark, sf_dir)
    sure = r.sure.groupBy("pair_id", "state").agg(F.count_distinct("s").alias("n_s"), F.count_distinct("t").alias("n_t"))
    amb = r.open_nodes.groupBy("pair_id").agg(F.lit("AMBIGUOUS").alias("state"), F.count_if(F.col("side") == "S").alias("n_s"), F.count_if(F.col("side") == "T").alias("n_t"))
    return r.graph.counts().join(sure.unionByName(amb.select(*sure.columns)), ["pair_id", "state"]).select("pair_id", "state", "n", "n_s", "n_t")


# --- alignment ------------------------------------------------------------------


@query(_sql("SELECT pair_id, 'region:' || sp || '->' || tp AS region_id, order_changed, unresolved, n_aligned, n_unresolved FROM reg"))
def align_regions(spark, sf_dir):
    return _result(spark, sf_dir).regions.select("pair_id", "region_id", "order_changed", "unresolved", "n_aligned", "n_unresolved")


@query(_sql("SELECT pair_id, sp, tp, block, pos, kind, s, t, confidence FROM pos"))
def align_positions(spark, sf_dir):
    return _result(spark, sf_dir).positions.select("pair_id", "sp", "tp", "block", "pos", "kind", "s", "t", "confidence")


@query(_sql("SELECT pair_id, sp, tp FROM reg WHERE order_changed"))
def align_order_changed(spark, sf_dir):
    return _result(spark, sf_dir).regions.where("order_changed").select("pair_id", "sp", "tp")


@query(_sql("SELECT pair_id, count(*) AS n_regions, sum(n_unresolved)::BIGINT AS n_positions FROM reg WHERE unresolved GROUP BY pair_id"))
def align_unresolved_regions(spark, sf_dir):
    return _result(spark, sf_dir).regions.where("unresolved").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_regions"), F.sum("n_unresolved").alias("n_positions"))


# --- operations -----------------------------------------------------------------


def _ops_query(name: str, types: str, sql: str, **parts) -> None:
    def run(spark, sf_dir):
        rows = _result(spark, sf_dir, **parts).operations.where(f"type in ({types})")
        return rows.select("pair_id", "operation_id", "type", "confidence")

    run.__name__ = name
    query(_sql(f"SELECT pair_id, operation_id, type, confidence FROM ops WHERE type IN ({types})", sql))(run)


_ops_query("ops_match_update", "'MATCH', 'UPDATE'", _OPS)
_ops_query("ops_insert_delete", "'INSERT', 'DELETE'", _OPS)
_ops_query("ops_insert_delete_emit_all", "'INSERT', 'DELETE'", _operations_sql("EMIT_ALL"), operation__presence_policy="EMIT_ALL")
_ops_query("ops_insert_delete_region_policy", "'INSERT', 'DELETE'", _operations_sql("SUPPRESS_UNRESOLVED_REGIONS"), operation__presence_policy="SUPPRESS_UNRESOLVED_REGIONS")
_ops_query("ops_reorder_unordered_parent", "'REORDER'", _operations_sql(unordered="nation"), alignment__order_by_type=(("nation", False),))


@query(_sql("SELECT pair_id, s, t, sp AS source_parent, expected AS from_parent, tp AS to_parent, confidence FROM mv", _OPS))
def ops_move(spark, sf_dir):
    r = _result(spark, sf_dir)
    parents = r.nodes.where("side = 'S'").select("pair_id", F.col("node_ref").alias("s"), F.col("parent_ref").alias("source_parent"))
    rows = r.operations.where("type = 'MOVE'").select("pair_id", F.col("source_refs")[0].alias("s"), F.col("target_refs")[0].alias("t"), "from_parent", "to_parent", "confidence")
    return rows.join(parents, ["pair_id", "s"])


@query(_sql("SELECT r.pair_id, r.sp, (SELECT string_agg(al.s, ';' ORDER BY al.pos, al.s) FROM al WHERE al.pair_id = r.pair_id AND al.sp = r.sp AND al.tp = r.tp) AS refs FROM reg r WHERE order_changed", _OPS))
def ops_reorder(spark, sf_dir):
    r = _result(spark, sf_dir)
    refs = F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])
    lists = r.siblings.groupBy("pair_id", "operation_id").agg(F.array_join(refs, ";").alias("refs"))
    rows = r.operations.where("type = 'REORDER'").join(lists, ["pair_id", "operation_id"])
    return rows.select("pair_id", F.substring_index("operation_id", ":", -1).alias("sp"), "refs")


@query(_sql("SELECT pair_id, type, count(*) AS n FROM ops GROUP BY ALL", _OPS))
def op_counts(spark, sf_dir):
    return _result(spark, sf_dir).operations.groupBy("pair_id", "type").agg(F.count(F.lit(1)).alias("n"))


# --- causes and suppression -----------------------------------------------------


@query(_sql("""SELECT pair_id, count(*) FILTER (type <> 'MATCH') AS n_roots,
    sum(CAST(confidence AS DECIMAL(18,6)) - CASE type WHEN 'MATCH' THEN 0.0 WHEN 'MOVE' THEN 1.5 WHEN 'REORDER' THEN 1.2 ELSE 1.0 END)::DOUBLE AS objective_score FROM ops GROUP BY pair_id""", _OPS))
def causal_summary(spark, sf_dir):
    return _result(spark, sf_dir).explanations.where("explanation_id = 'explanation-primary'").select("pair_id", "n_roots", "objective_score")


def _suppress_query(type_: str) -> None:
    def run(spark, sf_dir):
        rows = _result(spark, sf_dir).effects.where(F.col("root_operation_id").startswith(f"op:{type_.lower()}:"))
        return rows.select("pair_id", F.col("root_operation_id").alias("operation_id"), F.col("n_affected").alias("n"), "first_ref", "last_ref", "confidence")

    run.__name__ = f"suppress_{type_.lower()}"
    query(_sql(f"SELECT pair_id, operation_id, n, first_ref, last_ref, confidence FROM eff WHERE type = '{type_}'", _OPS, _AFFECTED))(run)


for _type in ("INSERT", "DELETE", "REORDER", "MOVE"):
    _suppress_query(_type)

# a move of customers, so that moved nodes have descendants
_MOVED = _NODES.replace("nodes AS (", "nodes0 AS (") + """,
hop AS (SELECT CAST(c_nationkey AS VARCHAR) AS pair_id, 'c' || c_custkey AS node_ref, 'c' || nk AS up FROM nxt WHERE c_custkey % 29 = 0 AND nk % 29 <> 0 AND nk <> c_custkey),
nodes AS (SELECT n.* REPLACE (CASE WHEN side = 'T' AND h.up IS NOT NULL THEN h.up ELSE parent_ref END AS parent_ref) FROM nodes0 n LEFT JOIN hop h ON h.pair_id = n.pair_id AND h.node_ref = n.node_ref)"""


def _moved(spark, sf_dir) -> Result:
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    hop = _table(spark, sf_dir, "customer").withColumn("nk", F.coalesce(F.lead("c_custkey").over(w), F.first("c_custkey").over(w)))
    hop = hop.where("c_custkey % 29 = 0 and nk % 29 <> 0 and nk <> c_custkey")
    hop = hop.select(F.col("c_nationkey").cast("string").alias("pair_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_ref"), F.concat(F.lit("c"), F.col("nk").cast("string")).alias("up"))
    rows = order_trees(spark, sf_dir).join(hop, ["pair_id", "node_ref"], "left")
    parent = F.when((F.col("side") == "T") & F.col("up").isNotNull(), F.col("up")).otherwise(F.col("parent_ref"))
    return reconcile(rows.withColumn("parent_ref", parent), DITA)


@query(_sql("SELECT pair_id, operation_id, n, first_ref, last_ref FROM eff WHERE type = 'MOVE'", _OPS, _AFFECTED, nodes=_MOVED))
def suppress_move_subtrees(spark, sf_dir):
    return _moved(spark, sf_dir).effects.where("category = 'DESCENDANT_PATH_CHANGED'").select("pair_id", F.col("root_operation_id").alias("operation_id"), F.col("n_affected").alias("n"), "first_ref", "last_ref")


@query(_sql("SELECT DISTINCT o.pair_id, o.s AS node_ref FROM ops o JOIN below b ON b.pair_id = o.pair_id AND b.node_ref = o.s WHERE o.type = 'UPDATE'", _OPS, _AFFECTED, nodes=_MOVED))
def suppress_retained_defects(spark, sf_dir):
    return _moved(spark, sf_dir).retained.select("pair_id", "node_ref")


@query(_sql("SELECT pair_id, type, count(*) AS n_effects, sum(n)::BIGINT AS n_refs FROM eff GROUP BY ALL", _OPS, _AFFECTED))
def suppress_counts_by_root(spark, sf_dir):
    rows = _result(spark, sf_dir).effects.withColumn("type", F.upper(F.split("root_operation_id", ":")[1]))
    return rows.groupBy("pair_id", "type").agg(F.count(F.lit(1)).alias("n_effects"), F.sum("n_affected").alias("n_refs"))


# --- trees ----------------------------------------------------------------------

_WALK = "WITH RECURSIVE " + _NODES + ", d AS (SELECT pair_id, side, node_ref, 1 AS depth FROM nodes WHERE parent_ref IS NULL UNION ALL SELECT n.pair_id, n.side, n.node_ref, d.depth + 1 FROM d JOIN nodes n ON n.pair_id = d.pair_id AND n.side = d.side AND n.parent_ref = d.node_ref) "


@query(_WALK + "SELECT pair_id, side, max(depth) AS depth, count(*) AS n FROM d GROUP BY ALL")
def tree_depth(spark, sf_dir):
    rows = evidence.depths(kept(order_trees(spark, sf_dir)), kept)
    return rows.groupBy("pair_id", "side").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE " + _NODES + ", d AS (SELECT pair_id, side, node_ref AS top, node_ref FROM nodes WHERE node_type <> 'order' UNION ALL SELECT n.pair_id, n.side, d.top, n.node_ref FROM d JOIN nodes n ON n.pair_id = d.pair_id AND n.side = d.side AND n.parent_ref = d.node_ref) SELECT pair_id, side, top, count(*) - 1 AS n FROM d GROUP BY ALL HAVING count(*) > 1")
def descendant_counts(spark, sf_dir):
    rows = kept(order_trees(spark, sf_dir))
    tops = rows.where("node_type <> 'order'").select("pair_id", "side", F.col("node_ref").alias("top"))
    return evidence.descendants(rows, tops, kept).groupBy("pair_id", "side", "top").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _NODES + """ SELECT pair_id, side, 'DANGLING_PARENT_REF' AS code, node_ref FROM nodes WHERE node_type = 'order' AND child_pos % 101 = 0
    UNION ALL SELECT pair_id, side, 'CONTAINMENT_CYCLE', node_ref FROM nodes WHERE node_type = 'order' AND child_pos % 103 = 0 AND child_pos % 101 <> 0
    UNION ALL SELECT pair_id, side, 'MULTIPLE_ROOTS', min(node_ref) FROM nodes WHERE (parent_ref IS NULL) OR (node_type = 'order' AND child_pos % 107 = 0 AND child_pos % 101 <> 0 AND child_pos % 103 <> 0) GROUP BY ALL HAVING count(*) > 1""")
def tree_violations(spark, sf_dir):
    order, k = F.col("node_type") == "order", F.col("child_pos")
    bad = F.when(order & (k % 101 == 0), F.lit("nowhere")).when(order & (k % 103 == 0), F.col("node_ref")).when(order & (k % 107 == 0), F.lit(None).cast("string")).otherwise(F.col("parent_ref"))
    return validate.tree_violations(kept(order_trees(spark, sf_dir).withColumn("parent_ref", bad)))


@query("WITH " + _NODES + " SELECT pair_id, 'nodes: ' || count(*) AS message FROM nodes GROUP BY pair_id HAVING count(*) > 1000")
def limits_exceeded(spark, sf_dir):
    return _result(spark, sf_dir, limits=Limits(max_node_count=1000)).over_limits


@query(_sql("""SELECT pair_id, 'candidates: ' || count(*) AS message FROM (
    SELECT s.pair_id, s.node_ref AS s, t.node_ref AS t FROM sfree s JOIN tfree t ON s.pair_id = t.pair_id AND s.sig = t.sig AND s.node_type = t.node_type
    UNION SELECT s.pair_id, s.node_ref, t.node_ref FROM sfree s JOIN tfree t ON s.pair_id = t.pair_id AND s.pid = t.pid AND s.node_type = t.node_type) GROUP BY pair_id HAVING count(*) > 20""", upto=3))
def limits_candidates(spark, sf_dir):
    return _result(spark, sf_dir, limits=Limits(max_candidates=20)).over_limits


@query(_sql("SELECT pair_id, 'MATCHING' AS stage, count(*) AS candidates, count(*) FILTER (state = 'CONFIRMED') AS results FROM m GROUP BY pair_id UNION ALL SELECT pair_id, 'ALIGNMENT', 0, count(*) FROM reg GROUP BY pair_id UNION ALL SELECT pair_id, 'CLASSIFICATION', 0, count(*) FROM ops GROUP BY pair_id", _OPS))
def stage_metrics(spark, sf_dir):
    return _result(spark, sf_dir).stage_counts("MATCHING", "ALIGNMENT", "CLASSIFICATION").select("pair_id", "stage", "candidates", "results")


@query(_sql("SELECT pair_id, operation_id, CASE type WHEN 'MATCH' THEN 'IDENTITY_PRESERVED' WHEN 'UPDATE' THEN 'CONTENT_CHANGED' WHEN 'MOVE' THEN 'CONFIRMED_IDENTITY;PARENT_CHANGED' WHEN 'REORDER' THEN 'SIBLING_ORDER_CHANGED' WHEN 'DELETE' THEN 'SOURCE_ONLY' ELSE 'TARGET_ONLY' END AS codes FROM ops", _OPS))
def ops_evidence_codes(spark, sf_dir):
    return _result(spark, sf_dir).operations.select("pair_id", "operation_id", F.array_join("evidence_codes", ";").alias("codes"))


@query(_sql("SELECT pair_id, operation_id FROM ops WHERE type IN ('DELETE', 'UPDATE')", _OPS))
def ops_enabled(spark, sf_dir):
    r = _result(spark, sf_dir)
    from dataclasses import replace

    from arboris.operators import classify

    context = classify.Context(r.graph.ends, r.linked, r.open_nodes, r.positions, r.regions, replace(DITA.operation, enabled=frozenset({"DELETE", "UPDATE"})))
    return classify.classify(context).select("pair_id", "operation_id")


# --- localization ---------------------------------------------------------------


def _localized(spark, sf_dir, policy: Policy | None = None) -> Localization:
    return Localization(_result(spark, sf_dir), "fr-FR", policy=policy)


@query(_sql("SELECT pair_id, status, source_ref, locale_ref, mc AS match_confidence, oc AS operation_confidence FROM iss", _OPS, _issues_sql()))
def loc_issues(spark, sf_dir):
    return _localized(spark, sf_dir).findings.select("pair_id", "status", "source_ref", "locale_ref", "match_confidence", "operation_confidence")


_ACTIONS = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in localization.ACTION.items()) + " ELSE 'NONE' END"
_SEVERITIES = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in localization.SEVERITY.items()) + " END"


@query(_sql(f"SELECT pair_id, status, {_SEVERITIES} AS severity, {_ACTIONS} AS action, count(*) AS n FROM iss GROUP BY ALL", _OPS, _issues_sql()))
def loc_issue_counts(spark, sf_dir):
    return _localized(spark, sf_dir).findings.groupBy("pair_id", "status", "severity", "action").agg(F.count(F.lit(1)).alias("n"))


@query(_sql("SELECT pair_id, status, count(*) AS n FROM iss GROUP BY ALL", _OPS, _issues_sql("order", 0.99)))
def loc_exemptions(spark, sf_dir):
    policy = Policy("fr-FR", (LocaleRule("extra-orders", "INSERT", ("order",)), LocaleRule("never", "INSERT")), 0.99)
    return _localized(spark, sf_dir, policy).findings.groupBy("pair_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'UNKNOWN' WHEN c_custkey % 3 = 0 THEN 'STALE' ELSE 'CURRENT' END AS state FROM customer")
def loc_translation_state(spark, sf_dir):
    k = F.col("c_custkey")
    source = F.create_map(F.lit("revision"), F.concat(F.lit("s:"), k.cast("string")))
    locale = F.create_map(F.lit("source-revision"), F.when(k % 4 != 0, F.concat(F.lit("s:"), (k + (k % 3 == 0).cast("int")).cast("string"))))
    return _table(spark, sf_dir, "customer").select("c_custkey", localization.translation_state([source], [locale]).alias("state"))


_REPAIRS = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in localization.REPAIR.items()) + " END"


@query(_sql(f"SELECT pair_id, {_REPAIRS} AS operation, coalesce(locale_ref, source_ref) AS target_node_ref, round(0.9e0 * least(coalesce(mc, 1e0), coalesce(oc, 1e0)), 6) AS repair_confidence FROM iss WHERE status IN ('WRONG_PARENT', 'WRONG_ORDER', 'MISSING_IN_LOCALE', 'EXTRA_IN_LOCALE')", _OPS, _issues_sql()))
def loc_recommendations(spark, sf_dir):
    return _localized(spark, sf_dir).recommendations.select("pair_id", "operation", "target_node_ref", "repair_confidence")


_COUNTS = """sums AS (SELECT pair_id, count(*) FILTER (status = 'CONFIRMED_MATCH') AS confirmed, count(*) FILTER (status = 'PROBABLE_MATCH') AS probable, count(*) FILTER (status = 'AMBIGUOUS_MATCH') AS ambiguous,
    count(*) FILTER (status = 'MISSING_IN_LOCALE') AS missing, count(*) FILTER (status = 'EXTRA_IN_LOCALE') AS extra, count(*) FILTER (status IN ('WRONG_PARENT', 'WRONG_ORDER')) AS structurally_divergent, count(*) AS direct_issue_count FROM iss GROUP BY pair_id)"""


@query(_sql("SELECT sums.*, (SELECT count(*) FROM eff WHERE eff.pair_id = sums.pair_id) AS suppressed_effect_count, (SELECT count(*) FROM reg WHERE reg.pair_id = sums.pair_id AND unresolved) AS unresolved_region_count FROM sums", _OPS, _AFFECTED, _issues_sql(), _COUNTS))
def loc_summary(spark, sf_dir):
    return _localized(spark, sf_dir).summary.drop("exempt", "has_errors")


@query(_sql("SELECT pair_id, round(missing * 0.5e0 + confirmed * 0.25e0, 6) AS hours, (missing * 40 + confirmed * 5)::DECIMAL(38,6)::DOUBLE AS price FROM sums", _OPS, _issues_sql(), _COUNTS))
def pricing_assessment(spark, sf_dir):
    rates = spark.createDataFrame([("missing", 0.5, "40"), ("confirmed", 0.25, "5")], "category string, hours double, price string")
    return localization.price(_localized(spark, sf_dir).summary, rates).withColumn("price", F.col("price").cast("double"))


# --- reports and jobs -----------------------------------------------------------


@query(_sql("SELECT pair_id AS job_id, status AS localization_status, false AS is_suppressed, count(*) AS n FROM iss GROUP BY ALL UNION ALL SELECT pair_id, 'SUPPRESSED_EFFECT', true, count(*) FROM eff GROUP BY pair_id", _OPS, _AFFECTED, _issues_sql()))
def report_rows(spark, sf_dir):
    return report.report_rows(_localized(spark, sf_dir)).groupBy(F.col("job_id"), "localization_status", "is_suppressed").agg(F.count(F.lit(1)).alias("n"))


@query(_sql("SELECT pair_id, round(missing / direct_issue_count::DOUBLE, 6) AS missing_rate, round(ambiguous / direct_issue_count::DOUBLE, 6) AS ambiguous_rate FROM sums", _OPS, _issues_sql(), _COUNTS))
def report_rates(spark, sf_dir):
    rates = F.from_json("json", "rates struct<missing: double, ambiguous: double>")["rates"]
    return report.summary_json(_localized(spark, sf_dir).summary).select(F.col("job_id").alias("pair_id"), rates["missing"].alias("missing_rate"), rates["ambiguous"].alias("ambiguous_rate"))


@query(_sql("SELECT pair_id, CASE WHEN bool_or(status IN ('MISSING_IN_LOCALE', 'WRONG_PARENT')) THEN 2 ELSE 0 END AS exit_code FROM iss GROUP BY pair_id", _OPS, _issues_sql()))
def exit_codes(spark, sf_dir):
    loc = _localized(spark, sf_dir)
    done = loc.result.nodes.select("pair_id").distinct().withColumn("state", F.lit("COMPLETED"))
    return jobs.exit_codes(done, loc.findings, "ERROR")


@query(_sql("SELECT pair_id, (SELECT count(*) FROM m WHERE m.pair_id = sums.pair_id) AS n_matches, (SELECT count(*) FROM ops WHERE ops.pair_id = sums.pair_id) AS n_operations, direct_issue_count AS n_issues, CASE WHEN missing + structurally_divergent > 0 THEN 'completed_with_issues' ELSE 'completed' END AS outcome FROM sums", _OPS, _issues_sql(), _COUNTS))
def observability(spark, sf_dir):
    loc = _localized(spark, sf_dir)
    done = loc.result.nodes.select("pair_id").distinct().select("pair_id", F.lit("COMPLETED").alias("state"), F.concat(F.lit("corr-"), "pair_id").alias("correlation_id"))
    return jobs.observability(done, loc).select("pair_id", "n_matches", "n_operations", "n_issues", "outcome")


# --- documents ------------------------------------------------------------------


@query("""SELECT CAST(event_id AS VARCHAR) AS pair_id, ref AS node_ref, kind AS node_type, up AS parent_ref, CASE WHEN ref = 'n.0.0' THEN 'k' END AS persistent_id, CASE WHEN ref = 'n.0.0' THEN props->>'$.k' END AS value
    FROM events, (VALUES ('n', 'data:document', NULL), ('n.0', 'data:object', 'n'), ('n.0.0', 'data:property', 'n.0')) x(ref, kind, up)""")
def json_nodes_events(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("pair_id"), F.lit("S").alias("side"), F.col("props").alias("content"))
    nodes = documents.nodes_of(documents.parse(rows, "generic-json-v1"))
    return nodes.select("pair_id", "node_ref", "node_type", "parent_ref", evidence.first_present(evidence.ID_KEYS).alias("persistent_id"), plain(F.col("content").getItem("text")).alias("value"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS pair_id, 'n' AS node_ref, 'map' AS node_type, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS navtitle FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'n.0', 'topicref', CASE WHEN c_custkey % 2 = 0 THEN 'keys:k' || c_custkey ELSE 'href:' || c_custkey || '.dita' END, c_mktsegment FROM customer""")
def dita_nodes_generated(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    key = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('keys=" k'), k, F.lit(' "'))).otherwise(F.lit(""))
    text = F.concat(F.lit("<map><topicref "), key, F.lit(' href="././'), k, F.lit('.dita"><topicmeta><navtitle> '), "c_mktsegment", F.lit(" </navtitle></topicmeta></topicref></map>"))
    rows = _table(spark, sf_dir, "customer").select(k.alias("pair_id"), F.lit("S").alias("side"), text.alias("content"))
    nodes = documents.nodes_of(documents.parse(rows, "dita-map-v1"))
    return nodes.select("pair_id", "node_ref", "node_type", plain(F.col("identity").getItem("id")).alias("id"), plain(F.col("content").getItem("navtitle")).alias("navtitle"))


def _kept_nodes(nodes: DataFrame) -> DataFrame:
    text = lambda m, k: F.col(m).getItem(k)
    return nodes.select("pair_id", "node_ref", "node_type", "parent_ref", "child_pos", text("identity", "id").alias("id"), text("identity", "key").alias("key"), F.coalesce(text("content", "value"), text("content", "text")).alias("value"), F.col("loc.xpath").alias("path"))


@query("""WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS pair_id, c_mktsegment AS seg FROM customer), none AS (SELECT CAST(NULL AS VARCHAR) AS x)
    SELECT pair_id, 'n' AS node_ref, 'r' AS node_type, CAST(NULL AS VARCHAR) AS parent_ref, 0::BIGINT AS child_pos, 's:' || k AS id, x AS key, 's:top' AS value, '/r' AS path FROM c, none
    UNION ALL SELECT pair_id, 'n.0', 'a', 'n', 0, 's:i' || k, x, 's:' || seg, '/r/a[1]' FROM c, none UNION ALL SELECT pair_id, 'n.0.0', 'b', 'n.0', 0, x, x, x, '/r/a[1]/b' FROM c, none
    UNION ALL SELECT pair_id, 'n.1', 'a', 'n', 1, x, x, 's:<&>', '/r/a[2]' FROM c, none""")
def xml_nodes_generated(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit('<r xmlns:z="urn:z" id="'), k, F.lit('">top<z:a xml:id="i'), k, F.lit('"> '), "c_mktsegment", F.lit(" <b/>tail</z:a><a>&lt;&amp;&gt;</a></r>"))
    rows = _table(spark, sf_dir, "customer").select(k.alias("pair_id"), F.lit("S").alias("side"), text.alias("content"))
    return _kept_nodes(documents.nodes_of(documents.parse(rows, "generic-xml-v1")))


#: Nodes of ``{"name": ..., "list": [1, 2.5, null, true, {"deep": []}]}``, as a path gives them.
_DATA_NODES = """WITH n AS (SELECT CAST(n_nationkey AS VARCHAR) AS pair_id, n_name AS name FROM nation)
    SELECT pair_id, ref AS node_ref, 'data:' || kind AS node_type, up AS parent_ref, pos::BIGINT AS child_pos, CAST(NULL AS VARCHAR) AS id, key, CASE WHEN ref = 'n.0.0' THEN 's:' || name ELSE value END AS value, path
    FROM n, (VALUES ('n', 'document', NULL, 0, NULL, NULL, '$'), ('n.0', 'object', 'n', 0, NULL, NULL, '$'), ('n.0.0', 'property', 'n.0', 0, 's:name', NULL, '$.name'), ('n.0.1', 'property', 'n.0', 1, 's:a list', NULL, '$["a list"]'),
        ('n.0.1.0', 'array', 'n.0.1', 0, NULL, NULL, '$["a list"]'), ('n.0.1.0.0', 'item', 'n.0.1.0', 0, NULL, 'i:1', '$["a list"][0]'), ('n.0.1.0.1', 'item', 'n.0.1.0', 1, NULL, 'f:2.5', '$["a list"][1]'),
        ('n.0.1.0.2', 'item', 'n.0.1.0', 2, NULL, 'n:', '$["a list"][2]'), ('n.0.1.0.3', 'item', 'n.0.1.0', 3, NULL, 'b:true', '$["a list"][3]'), ('n.0.1.0.4', 'item', 'n.0.1.0', 4, NULL, NULL, '$["a list"][4]'),
        ('n.0.1.0.4.0', 'object', 'n.0.1.0.4', 0, NULL, NULL, '$["a list"][4]'), ('n.0.1.0.4.0.0', 'property', 'n.0.1.0.4.0', 0, 's:deep', NULL, '$["a list"][4].deep'), ('n.0.1.0.4.0.0.0', 'array', 'n.0.1.0.4.0.0', 0, NULL, NULL, '$["a list"][4].deep')) x(ref, kind, up, pos, key, value, path)"""


def _data_query(form: str, text) -> None:
    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("pair_id"), F.lit("S").alias("side"), text().alias("content"))
        return _kept_nodes(documents.nodes_of(documents.parse(rows, f"generic-{form}-v1")))

    run.__name__ = f"{form}_nodes_nested"
    query(_DATA_NODES)(run)


_data_query("json", lambda: F.concat(F.lit('{"name": "'), "n_name", F.lit('", "a list": [1, 2.5, null, true, {"deep": []}]}')))
_data_query("yaml", lambda: F.concat(F.lit('name: "'), "n_name", F.lit('"\na list:\n- 1\n- 2.5\n- ~\n- true\n- deep: []\n')))

# documents that must be refused, and with which code; fixed values
_REFUSED = (
    ("generic-xml-v1", '<!DOCTYPE r [<!ENTITY x SYSTEM "file:///etc/passwd">]><r>&x;</r>', "UNSAFE_XML"), ("generic-xml-v1", '<!DOCTYPE l [<!ENTITY a "aa"><!ENTITY b "&a;&a;">]><l>&b;</l>', "UNSAFE_XML"),
    ("generic-xml-v1", "<a>" * 101 + "</a>" * 101, "UNSAFE_XML"), ("generic-xml-v1", "<a><b></a>", "INVALID_INPUT"), ("dita-map-v1", "", "INVALID_INPUT"), ("generic-json-v1", "[" * 101 + "]" * 101, "UNSAFE_JSON"),
    ("generic-json-v1", '{"a": NaN}', "INVALID_INPUT"), ("generic-json-v1", "[1e999]", "UNSAFE_JSON"), ("generic-json-v1", '{"a": 1', "INVALID_INPUT"), ("generic-yaml-v1", "a: &x 1\nb: *x", "UNSAFE_YAML"),
    ("generic-yaml-v1", "a: !!python/object:os.system 1", "UNSAFE_YAML"), ("generic-yaml-v1", "a: 1\n---\nb: 2", "UNSAFE_YAML"), ("generic-yaml-v1", "1: x", "UNSAFE_YAML"), ("generic-yaml-v1", "a: [", "INVALID_INPUT"),
)


@query("SELECT CAST(n_nationkey AS VARCHAR) || '-' || no AS pair_id, code AS error_code FROM nation, (VALUES " + ", ".join(f"({i}, '{code}')" for i, (_, _, code) in enumerate(_REFUSED)) + ") x(no, code)")
def documents_refused(spark, sf_dir):
    from functools import reduce

    nation = _table(spark, sf_dir, "nation")
    out = []
    for profile in dict.fromkeys(p for p, _, _ in _REFUSED):
        cases = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(text).alias("content")) for i, (p, text, _) in enumerate(_REFUSED) if p == profile))
        rows = nation.select("n_nationkey", F.inline(cases)).select(F.concat_ws("-", F.col("n_nationkey").cast("string"), F.col("no").cast("string")).alias("pair_id"), F.lit("S").alias("side"), "content")
        out.append(documents.refused(documents.parse(rows, profile)).select("pair_id", "error_code"))
    return reduce(DataFrame.unionByName, out)


@query("SELECT 'INVALID_INPUT' AS error_code, count(*) AS n FROM pages")
def html_pages_rejected(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("pair_id"), F.lit("S").alias("side"), F.col("html").alias("content"))
    return documents.refused(documents.parse(rows, "generic-xml-v1")).groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, role || '|' || text AS x FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS pair_id, 'MATCH' AS type, count(*) AS n FROM t WHERE turn % 3 <> 2 GROUP BY conv_id
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 'DELETE', count(*) FROM t WHERE turn % 3 = 2 GROUP BY conv_id""")
def conversation_tree_diff(spark, sf_dir):
    conv = _table(spark, sf_dir, "conversations")
    cid = F.col("conv_id").cast("string")
    none = F.create_map().cast("map<string,string>")

    def side(which: str, rows: DataFrame) -> DataFrame:
        from arboris.sources.edges import from_edges

        kids = rows.select(cid.alias("pair_id"), F.lit(which).alias("side"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("node_ref"), F.lit("turn").alias("node_type"), F.lit("root").alias("parent_ref"), F.col("turn").alias("child_pos"), none.alias("identity"), F.create_map(F.lit("text"), F.concat("role", F.lit("|"), "text", F.lit("|"), F.col("turn").cast("string"))).alias("content"))
        root = conv.select(cid.alias("pair_id")).distinct().select("pair_id", F.lit(which).alias("side"), F.lit("root").alias("node_ref"), F.lit("conversation").alias("node_type"), F.lit(None).cast("string").alias("parent_ref"), F.lit(0).cast("long").alias("child_pos"), F.create_map(F.lit("id"), F.lit("root")).alias("identity"), none.alias("content"))
        return from_edges(root.unionByName(kids))

    nodes = side("S", conv).unionByName(side("T", conv.where("turn % 3 <> 2")))
    return reconcile(nodes.select(*NODES.names), DITA).operations.groupBy("pair_id", "type").agg(F.count(F.lit(1)).alias("n"))


# --- utilities without SQL --------------------------------------------------------


@query()
def lcs_align(spark, sf_dir):
    rows = order_trees(spark, sf_dir).where("node_type = 'customer'").groupBy("pair_id", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("child_pos", "node_ref"))), lambda x: x["node_ref"]).alias("refs"))
    both = rows.where("side = 'S'").select("pair_id", F.col("refs").alias("l")).join(rows.where("side = 'T'").select("pair_id", F.col("refs").alias("r")), "pair_id")
    steps = both.select("pair_id", F.explode(lcs.lcs_align("l", "r")).alias("step"))
    return steps.groupBy("pair_id", F.col("step.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query()
def html_report(spark, sf_dir):
    return report.html_report(_localized(spark, sf_dir), redact=True).select("job_id", "section", "part", F.length("html").alias("n_chars"))


@query()
def fingerprint(spark, sf_dir):
    return _result(spark, sf_dir).fingerprint()
