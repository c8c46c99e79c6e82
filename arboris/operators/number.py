"""Numbers of rows in order within their keys, and falls in an order, without one task per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arboris.storage import kept


#: First rows of so many keys are broadcast.
FEW = 5000


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: the place, from 1, of each row among the rows of equal ``keys`` in ``order``.

    Rows are dealt by ranges of keys and order and sorted, so a key that holds most rows is the work of many tasks.
    A row's place in the whole order is its place in its range, which the engine's ascending ids give, and the sizes
    of the ranges before it; a key's numbers start after the place of its first row. So beside the sorted rows only a
    row for each range and one for each key are looked at. First rows of at most FEW keys are broadcast, so that rows of
    few keys aren't shuffled by them. The ranges are staged, as a second run could draw other
    bounds. Rows that ``order`` can't tell apart get numbers in any order; null keys are equal to each other.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = kept(df.repartitionByRange(_ranges(df), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, starts, n_keys = 0, [], 0
    distinct = F.approx_count_distinct(F.struct(*keys)) if keys else F.lit(0)
    for r in sorted(dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), distinct.alias("k")).collect()):  # a row for each range
        starts.append((r["p"], before))
        before += r["n"]
        n_keys += r["k"]  # a key counts in each of its ranges
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _before long")

    def place(rows: DataFrame) -> DataFrame:
        at = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
        return rows.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_p")).withColumn("_place", at).drop("_p", "_before", "_at")

    placed = place(dealt)
    if not keys:
        return placed.select(*df.columns, F.col("_place").alias(name))
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    first = place(dealt.groupBy(*keys).agg(F.min("_at").alias("_at"))).select(*named, F.col("_place").alias("_first"))
    if n_keys <= FEW + len(starts):
        first = F.broadcast(first)
    met = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    return placed.join(first, met).select(*df.columns, (F.col("_place") - F.col("_first") + 1).alias(name))


def falls(df: DataFrame, keys: list[str], order: list[str], by: list[str], name: str) -> DataFrame:
    """keys and ``name``: whether the rows of equal ``keys``, in ``order``, are anywhere out of the order of ``by``.

    Rows are dealt by ranges of keys and order. A range compares neighbours; of what stands at its ends only one row for each
    key and range is left, and the ends of neighbouring ranges are compared in turn.
    """
    at, value = F.struct(*order), F.struct(*by)
    dealt = kept(df.select(*keys, at.alias("_at"), value.alias("_by")).repartitionByRange(_ranges(df), *keys, "_at").withColumn("_range", F.spark_partition_id()))
    last = F.lag("_by").over(Window.partitionBy(*keys, "_range").orderBy("_at"))
    inside = dealt.withColumn("_fell", F.coalesce(F.col("_by") < last, F.lit(False))).groupBy(*keys, "_range")
    ends = inside.agg(F.bool_or("_fell").alias("_fell"), F.min_by("_by", "_at").alias("_first"), F.max_by("_by", "_at").alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range"))
    rows = ends.withColumn("_fell", F.col("_fell") | F.coalesce(F.col("_first") < before, F.lit(False)))
    return rows.groupBy(*keys).agg(F.bool_or("_fell").alias(name))
