"""Trees from tables: any DataFrame of parent-child edges is a forest of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arboris.functions.text import tagged
from arboris.schema import NODES, SOURCE, TARGET


def props(**values: Column) -> Column:
    """A property map of string columns; null values are absent keys."""
    if len(values) == 1:  # without functions over arrays, which aren't compiled
        (k, v), = values.items()
        return F.when(v.isNotNull(), F.create_map(F.lit(k), tagged(v.cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), tagged(v.cast("string")).alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def from_edges(df: DataFrame) -> DataFrame:
    """A node table from columns pair_id, side, node_ref, node_type, parent_ref, child_pos and any of
    identity, content, structural (string maps of plain texts) and loc."""
    out = []
    for f in NODES:
        if f.name not in df.columns:
            empty = F.create_map().cast(f.dataType) if f.name != "loc" else F.lit(None).cast(f.dataType)
            out.append(empty.alias(f.name))
        elif f.name in ("identity", "content", "structural"):
            out.append(F.coalesce(F.transform_values(f.name, lambda k, v: tagged(v)), F.create_map().cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of trees per nation that the order tables hold: nation, its customers, their orders.

    The target side differs in set ways: customers of nations divisible by 5 come in reverse, orders
    divisible by 11 are gone, by 13 hang under the next customer of the nation, by 7 have other content,
    by 17 have an extra copy ``x``; orders divisible by 10 carry no id on either side.
    """
    from pyspark.sql import Window

    nation, customer, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer", "orders"))
    s = lambda c: c.cast("string")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    customer = customer.withColumn("nk", F.coalesce(F.lead("c_custkey").over(w), F.first("c_custkey").over(w)))
    placed = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])

    def rows(df: DataFrame, side: str, pair: Column, ref: Column, kind: str, parent: Column, pos: Column, pid: Column, text: Column) -> DataFrame:
        none = F.lit(None).cast(NODES["loc"].dataType)
        return df.select(
            s(pair).alias("pair_id"), F.lit(side).alias("side"), ref.alias("node_ref"), F.lit(kind).alias("node_type"), parent.cast("string").alias("parent_ref"),
            pos.cast("long").alias("child_pos"), props(id=pid).alias("identity"), props(t=text).alias("content"), F.create_map().cast("map<string,string>").alias("structural"), none.alias("loc"),
        )

    null = F.lit(None).cast("string")
    c = F.col
    key, nk, ck, o = c("n_nationkey"), c("c_nationkey"), c("c_custkey"), c("o_orderkey")
    of = F.concat(F.lit("c"), s(c("o_custkey")))
    text = F.concat(c("o_orderstatus"), F.lit("|"), c("o_orderpriority"))
    pid = F.when(o % 10 != 0, F.concat(F.lit("O"), s(o)))
    cust = (F.concat(F.lit("c"), s(ck)), "customer", F.concat(F.lit("n"), s(nk)))
    ref = F.concat(F.lit("o"), s(o))
    out = []
    for side in (SOURCE, TARGET):
        out.append(rows(nation, side, key, F.concat(F.lit("n"), s(key)), "nation", null, F.lit(0), F.concat(F.lit("N"), s(key)), null))
        pos = ck if side == SOURCE else F.when(nk % 5 == 0, -ck).otherwise(ck)
        out.append(rows(customer, side, nk, *cust, pos, F.concat(F.lit("C"), s(ck)), c("c_mktsegment")))
    out.append(rows(placed, SOURCE, nk, ref, "order", of, o, pid, text))
    moved = F.concat(F.lit("c"), s(F.when(o % 13 == 0, c("nk")).otherwise(c("o_custkey"))))
    out.append(rows(placed.where(o % 11 != 0), TARGET, nk, ref, "order", moved, o, pid, F.concat(text, F.when(o % 7 == 0, F.lit("*")).otherwise(F.lit("")))))
    out.append(rows(placed.where(o % 17 == 0), TARGET, nk, F.concat(F.lit("x"), s(o)), "order", of, o, F.concat(F.lit("X"), s(o)), text))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every
