"""Identity evidence of nodes: persistent id, label, signatures, duplicate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arboris.functions.text import plain
from arboris.operators.number import numbered
from arboris.storage import kept

ID_KEYS = ("id", "xml:id", "guid", "key")
LABEL_KEYS = ("label", "title", "navtitle")


def first_present(keys: tuple[str, ...]) -> Column:
    """First of ``keys`` with a non-empty string, in identity or else in content."""

    def one(key: str) -> Column:
        value = F.coalesce(F.col("identity").getItem(key), F.col("content").getItem(key))
        return F.when(value.startswith("s:") & (F.length(value) > 2), plain(value))

    return F.coalesce(*(one(k) for k in keys))


def _entries(props: Column, without: tuple[str, ...] = ()) -> Column:
    """Sorted ``key=value`` texts with the lengths of the keys, so that no two maps share one."""
    some = F.map_filter(props, lambda k, v: ~k.isin(*without)) if without else props
    return F.array_join(F.transform(F.sort_array(F.map_entries(some)), lambda e: F.concat(F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lit("="), F.length(e["value"]).cast("string"), F.lit(":"), e["value"])), "|")


def _folded(literal: Column) -> Column:
    """A literal such that numbers and booleans of equal value are equal."""
    number = F.when(literal == "b:true", F.lit(1.0)).when(literal == "b:false", F.lit(0.0)).otherwise(F.try_to_number(plain(literal), F.lit("S999999999999999999D999999999")).cast("double"))
    return F.when(literal.rlike("^[ifb]:") & number.isNotNull(), F.concat(F.lit("#:"), number.cast("string"))).otherwise(literal)


#: The property bags of a node, and its place in a document.
BAGS = ("identity", "content", "structural", "loc")


def extract(nodes: DataFrame, stage=None) -> DataFrame:
    """``nodes`` with persistent_id, label, signature, child_signature, eq_content and id_dup_count.

    With ``stage`` they come without ``BAGS``: what is read from these is written once before the joins, as filters on an id
    would otherwise repeat the expressions over maps that it is from, many times a row.
    """
    signature = F.concat_ws("\u0001", F.concat(F.lit("type="), "node_type"), F.coalesce(_entries(F.col("identity"), ID_KEYS), F.lit("")), "_content")
    # texts alone are equal as they are
    folds = F.exists(F.map_values("content"), lambda v: v.rlike("^[ifb]:"))
    equal = F.when(folds, F.coalesce(_entries(F.transform_values("content", lambda k, v: _folded(v))), F.lit(""))).otherwise(F.col("_content"))
    rows = (
        nodes.withColumn("_content", F.coalesce(_entries(F.col("content")), F.lit(""))).withColumn("persistent_id", first_present(ID_KEYS)).withColumn("label", first_present(LABEL_KEYS))
        .withColumn("signature", F.md5(signature.cast("binary"))).withColumn("eq_content", F.md5(equal.cast("binary"))).drop("_content")
    )
    if stage is not None:
        rows = nodes = stage(rows.drop(*BAGS))
    # ids that stand more than once are few: most rows need no join for their count. Hashes tell which ids may be among them.
    key = ["pair_id", "side", "persistent_id"]
    known = rows.where("persistent_id is not null").select(*key).withColumn("_h", F.xxhash64(*key))
    alike = known.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    alike = kept(alike)
    ids = kept(known.join(alike, "_h", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("id_dup_count")).where("id_dup_count > 1"))
    rows = rows.join(ids, key, "left").withColumn("id_dup_count", F.coalesce("id_dup_count", F.when(F.col("persistent_id").isNotNull(), F.lit(1).cast("long"))))
    # a row for each parent at most: hashed by partitions, so that the nodes need no sort
    digests = child_digests(nodes).select("pair_id", "side", "node_ref", F.col("digest").alias("child_signature")).hint("shuffle_hash")
    rows = rows.join(digests, ["pair_id", "side", "node_ref"], "left")
    return rows.withColumn("child_signature", F.coalesce("child_signature", F.lit("")))


def child_digests(nodes: DataFrame) -> DataFrame:
    """pair_id, side, node_ref and digest of the types of each parent's children in order (child_pos, node_ref).

    A sequence's digest is its length and two sums, modulo nothing, of 60 bits each of a hash of place and type: equal
    sequences have equal sums, unequal ones don't but by a chance of about 2^-60 in each. Sums are added up wherever the
    children are, so that a parent's children never meet in one row or task.
    """
    kids = nodes.where("parent_ref is not null").select("pair_id", "side", "parent_ref", "child_pos", "node_ref", "node_type")
    placed = numbered(kids, ["pair_id", "side", "parent_ref"], ["child_pos", "node_ref"], "place")
    h = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.coalesce("node_type", F.lit(""))).cast("binary"))
    placed = placed.select("pair_id", "side", "parent_ref", *(F.conv(F.substring(h, start, 15), 16, 10).cast("long").alias(n) for n, start in (("a", 1), ("b", 16))))

    def total(c: str) -> Column:
        # sums of both halves of the bits stay longs for 2^33 children, and are faster than sums of decimals
        high, low = F.sum(F.shiftright(c, 30)), F.sum(F.col(c).bitwiseAND((1 << 30) - 1))
        return (high.cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")

    digest = F.concat_ws(":", F.count(F.lit(1)).cast("string"), total("a"), total("b"))
    return placed.groupBy("pair_id", "side", F.col("parent_ref").alias("node_ref")).agg(digest.alias("digest"))


def child_types(nodes: DataFrame) -> DataFrame:
    """pair_id, side, node_ref and types: the text that ``child_digests`` stand for, on request, as it is as long as a parent has children."""
    child = F.struct("child_pos", "node_ref", "node_type")
    kids = nodes.where("parent_ref is not null").groupBy("pair_id", "side", F.col("parent_ref").alias("node_ref"))
    return kids.agg(F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda x: x["node_type"]), ",").alias("types"))


def duplicate_ids(evidence: DataFrame) -> DataFrame:
    """pair_id, side, persistent_id and n of the ids that stand on more than one node."""
    return evidence.where("id_dup_count > 1").groupBy("pair_id", "side", "persistent_id").agg(F.count(F.lit(1)).alias("n"))


def ancestry(nodes: DataFrame, stage, tops: DataFrame | None = None) -> DataFrame:
    """pair_id, side, node_ref, depth (root: 1), ends and near, one row a node; a ref that stands on several rows is one node.

    ``ends`` says where the way up leads: ROOT, MISSING (to a parent that isn't there) or CYCLE; depth is null off the
    root. ``near`` is the nearest proper ancestor among ``tops`` (pair_id, side, top), or null. Each round doubles the
    length of the jumps, so a chain of depth d takes log2(d) rounds, and there is no limit to d. A round that finishes
    no node ends the search: as depths have no gaps, what is left then hangs on cycles.
    """
    key = ["pair_id", "side"]
    first = nodes.groupBy(*key, "node_ref").agg(F.bool_or(F.col("parent_ref").isNull()).alias("top"), F.min("parent_ref").alias("up"))
    state = first.select(*key, "node_ref", F.when(~F.col("top"), F.col("up")).alias("jump"), F.when(F.col("top"), 0).otherwise(1).cast("long").alias("steps"), F.lit(False).alias("lost"))
    if tops is None:
        state = state.withColumn("near", F.lit(None).cast("string"))
    else:
        held = tops.select(*key, F.col("top").alias("jump"), F.col("top").alias("near")).distinct()
        state = state.where("jump is not null").join(held, [*key, "jump"], "left").unionByName(state.where("jump is null").withColumn("near", F.lit(None).cast("string")))
    columns = [*key, "node_ref", "jump", "steps", "lost", "near"]
    state, before = stage(state.select(*columns)), -1
    while True:
        climbing = state.where("jump is not null")
        n = climbing.count()
        if n in (0, before):
            break
        before = n
        up = state.select(*key, F.col("node_ref").alias("jump"), F.col("jump").alias("next"), F.col("steps").alias("more"), F.col("lost").alias("off"), F.col("near").alias("far"), F.lit(True).alias("there"))
        met = climbing.join(up, [*key, "jump"], "left").select(
            *key, "node_ref", F.col("next").alias("jump"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("off", F.col("there").isNull()).alias("lost"), F.coalesce("near", "far").alias("near")
        )
        state = stage(state.where("jump is null").select(*columns).unionByName(met))
    ends = F.when(F.col("jump").isNotNull(), "CYCLE").when(F.col("lost"), "MISSING").otherwise("ROOT")
    out = state.withColumn("ends", ends)
    return out.select(*key, "node_ref", F.when(F.col("ends") == "ROOT", F.col("steps") + 1).alias("depth"), "ends", "near")


def depths(nodes: DataFrame, stage) -> DataFrame:
    """pair_id, side, node_ref and depth (root: 1) of the nodes from which parents lead to a root."""
    return ancestry(nodes, stage).where("ends = 'ROOT'").select("pair_id", "side", "node_ref", "depth")


def descendants(nodes: DataFrame, tops: DataFrame, stage) -> DataFrame:
    """pair_id, side, top, node_ref: strict descendants of ``tops`` (pair_id, side, top). Nodes on or below a cycle are left out.

    A node's tops are its nearest one, that one's nearest, and so on: as many joins as tops are nested, whatever the
    depth of the trees. Only trees that hold a top are looked at.
    """
    key = ["pair_id", "side"]
    tops = tops.select(*key, "top").distinct()
    near = ancestry(nodes.join(tops.select(*key).distinct(), key, "left_semi"), stage, tops).where("ends <> 'CYCLE' and near is not null")
    near = stage(near.select(*key, F.col("near").alias("top"), "node_ref"))
    above = near.select(*key, F.col("node_ref").alias("top"), F.col("top").alias("next")).join(tops, [*key, "top"], "left_semi")
    out = front = near
    while not front.isEmpty():
        front = stage(front.join(above, [*key, "top"]).select(*key, F.col("next").alias("top"), "node_ref"))
        out = out.unionByName(front)
    return out
