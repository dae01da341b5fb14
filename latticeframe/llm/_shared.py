"""Helpers that the training-data operators share: tables in the shared folder and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import fresh_path, remove, scratch, shared_dir  # noqa: F401
from ..tables import kept as stored

BATCH_BYTES, DEFAULT_BYTES = 1 << 23, "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, where the session leaves the default of 64 MB: JVM and worker hold some of them each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` (a, b) with the smallest node it reaches: columns ``node``, ``component``.

    Alternating large-star and small-star rounds; each round is two partial minima and two equi-joins, and is
    written to the shared folder.  Rounds grow with the logarithm of the longest path.  Self loops label themselves;
    rows with a null end are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = e.where(edges["a"].isNotNull() & edges["b"].isNotNull()).distinct()
    loops = e.where("u = v").select("u", "v")
    e, path = stored(e.where("u <> v"), "stars")
    kind = e.schema["u"].dataType
    digest = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, new_path = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        after = digest(nxt)
        remove(spark, path)
        e, path = nxt, new_path
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).unionAll(loops.selectExpr("u AS node", "v AS component"))
    out = members.unionAll(roots).groupBy("node").agg(F.min("component").alias("component"))
    return out.select(F.col("node").cast(kind), F.col("component").cast(kind))
