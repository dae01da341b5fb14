"""Schemas of the library's tables.  Assertion times are unsigned in principle; values above 2**63 - 1 are rejected."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("assertion_time", T.LongType(), False), T.StructField("valid_time", T.LongType(), False)])
EDGE = T.StructType([T.StructField("target", T.BinaryType(), False), T.StructField("weight", T.FloatType(), False), T.StructField("edge_type", T.IntegerType(), False)])

#: What a caller hands in.
NODE_INPUT = T.StructType([
    T.StructField("key", T.BinaryType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
    T.StructField("temporal", T.ArrayType(POINT, False), False), T.StructField("edges", T.ArrayType(EDGE, False), False),
])
#: What the store keeps: one row a node.
NODE = T.StructType([
    T.StructField("id", T.BinaryType(), False), T.StructField("temporal", T.ArrayType(POINT, False), False), T.StructField("vector", T.ArrayType(T.ByteType(), False), False),
    T.StructField("quantization_scale", T.FloatType(), False), T.StructField("square_norm", T.LongType(), False), T.StructField("edges", T.ArrayType(EDGE, False), False),
])
CELLED_NODE = T.StructType([*NODE.fields, T.StructField("cell", T.IntegerType())])
RECORD = T.StructType([
    T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False), T.StructField("valid_from", T.LongType(), False),
    T.StructField("valid_to", T.LongType(), False), T.StructField("asserted_at", T.LongType(), False),
])
QUERY_ROW = T.StructType([T.StructField("id", T.BinaryType(), False), T.StructField("score", T.FloatType(), False), T.StructField("depth", T.IntegerType(), False)])
KV_BLOCK = T.StructType([T.StructField("idx", T.IntegerType(), False), T.StructField("payload", T.BinaryType(), False), T.StructField("crc32", T.LongType(), False), T.StructField("sha256", T.StringType(), False)])
