"""Exact percentiles without a single task that sees all values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with p<percent> for each share: the least value that so large a share of the values doesn't exceed.

    Distinct values are counted, range-partitioned and written; one number a partition says which partitions hold the
    ranks, and only within those are counts summed up.  Nulls are left out; without values every percentile is null.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = stored(counts.repartitionByRange(n, "value").select("value", "n", F.spark_partition_id().alias("part")), "ranks")
    total, before, held = 0, {}, {}
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        before[r["part"]], held[r["part"]], total = total, r["n"], total + r["n"]
    ranks = {p: max(1, math.ceil(p * total)) for p in shares}
    wanted = {p: next((k for k in before if before[k] < rank <= before[k] + held[k]), None) for p, rank in ranks.items()}
    parts = sorted({k for k in wanted.values() if k is not None})
    running = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    some = placed.where(F.col("part").isin(parts)).withColumn("upto", running)
    cut = lambda p: F.min(F.when((F.col("part") == wanted[p]) & (F.col("upto") >= ranks[p] - before.get(wanted[p], 0)), F.col("value")))
    return some.agg(*((cut(p) if wanted[p] is not None else F.lit(None).cast(rows.schema[column].dataType)).alias(f"p{round(p * 100)}") for p in shares))
