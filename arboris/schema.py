"""Schema of node tables and the order of their columns.

A row is a node of one of the two trees (``side`` S or T) of a pair. Property
values are literals tagged with their type (``s:text``, ``i:1``, ``f:1.5``,
``b:true``, ``n:``, ``j:{...}``), so that equal texts of unequal types differ.
"""

from __future__ import annotations

from pyspark.sql import types as T

PROPERTIES = T.MapType(T.StringType(), T.StringType())
LOCATION = T.StructType([
    T.StructField("document_uri", T.StringType()), T.StructField("line", T.IntegerType()),
    T.StructField("column", T.IntegerType()), T.StructField("xpath", T.StringType()),
])
NODES = T.StructType([
    T.StructField("pair_id", T.StringType()), T.StructField("side", T.StringType()), T.StructField("node_ref", T.StringType()),
    T.StructField("node_type", T.StringType()), T.StructField("parent_ref", T.StringType()), T.StructField("child_pos", T.LongType()),
    T.StructField("identity", PROPERTIES), T.StructField("content", PROPERTIES), T.StructField("structural", PROPERTIES), T.StructField("loc", LOCATION),
])
SOURCE, TARGET = "S", "T"
