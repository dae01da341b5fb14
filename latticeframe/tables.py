"""Tables written once to the folder that all executors share, to cut lineage between rounds.

Every such folder is removed when the driver ends; one made within ``scratch`` is removed when that block ends.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, the context's own, and in local mode a folder of ours.

    On a cluster without either this is an error: a driver's own folder would be another one on every executor.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names the folder that all executors share; it must be set on a cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="latticeframe-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of a folder that doesn't exist yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        target, fs = _path(spark, p)
        fs.delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes what is stored within the block when it ends; results must be written before."""
    _scopes.append([])
    try:
        yield
    finally:
        remove(spark, *_scopes.pop())


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read back, and where it lies: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    target, fs = _path(spark, path)
    fs.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    return kept(df, name)[0]
