"""Arrow in and out: node rows for ingest, result batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidVector

FLAT = ("key", "vector", "assertion_time", "valid_time")


def node_rows(spark: SparkSession, rows: pa.Table | DataFrame) -> DataFrame:
    """Flat rows (key, vector, assertion_time, valid_time) as nodes with one point and no edges; nulls are errors."""
    if isinstance(rows, pa.Table):
        missing = [c for c in FLAT if c not in rows.column_names]
        if missing:
            raise InvalidVector(f"missing columns {missing}")
        table = rows.select(list(FLAT))
        if any(table.column(c).null_count for c in FLAT):
            raise InvalidVector("ingest takes no nulls")
        vector = table.column("vector").cast(pa.list_(pa.float32()))
        table = table.set_column(1, "vector", vector)
        for k, c in ((2, "assertion_time"), (3, "valid_time")):
            table = table.set_column(k, c, table.column(c).cast(pa.int64()))
        rows = spark.createDataFrame(table)
    elif not rows.where(" OR ".join(f"{c} IS NULL" for c in FLAT)).isEmpty():
        raise InvalidVector("ingest takes no nulls")
    point = F.array(F.struct(F.col("assertion_time").cast("long").alias("assertion_time"), F.col("valid_time").cast("long").alias("valid_time")))
    none = F.array().cast("array<struct<target:binary,weight:float,edge_type:int>>")
    return rows.select(F.col("key").cast("binary").alias("key"), F.col("vector").cast("array<float>").alias("vector"), point.alias("temporal"), none.alias("edges"))


def result_batches(table: pa.Table, rows: int = 1024) -> list[pa.RecordBatch]:
    batches = table.combine_chunks().to_batches(max_chunksize=rows)
    return batches or [pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)]
