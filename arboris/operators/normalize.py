"""Normalisation of content properties, and its trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arboris.functions.text import collapsed, plain
from arboris.profiles import Normalization


def _value(profile: Normalization, key: Column, value: Column) -> Column:
    if not profile.collapse_whitespace:
        return value
    change = value.startswith("s:")
    if profile.preserve_property_keys:
        change = change & ~key.isin(*profile.preserve_property_keys)
    return F.when(change, F.concat(F.lit("s:"), collapsed(plain(value)))).otherwise(value)


def normalize(nodes: DataFrame, profile: Normalization) -> DataFrame:
    """``nodes`` without non-semantic content keys and with white space collapsed in the others."""
    content = F.col("content")
    if profile.nonsemantic_metadata_keys:
        content = F.map_filter(content, lambda k, v: ~k.isin(*profile.nonsemantic_metadata_keys))
    return nodes.withColumn("content", F.transform_values(content, lambda k, v: _value(profile, k, v)))


def trace(nodes: DataFrame, profile: Normalization) -> DataFrame:
    """What normalisation changes: pair_id, side, node_ref, key, rule (DROPPED or COLLAPSED)."""
    rows = nodes.select("pair_id", "side", "node_ref", F.explode("content").alias("key", "value"))
    dropped = F.col("key").isin(*profile.nonsemantic_metadata_keys) if profile.nonsemantic_metadata_keys else F.lit(False)
    changed = _value(profile, F.col("key"), F.col("value")) != F.col("value")
    rule = F.when(dropped, "DROPPED").when(changed, "COLLAPSED")
    return rows.select("pair_id", "side", "node_ref", "key", rule.alias("rule")).where("rule is not null")
