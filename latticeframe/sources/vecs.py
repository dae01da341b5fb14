"""Readers of ``.fvecs`` and ``.ivecs`` files: rows of a 32-bit length and that many 32-bit numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidVector


def _read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for content in b.column(1):
                data = content.as_py()
                if not data:
                    continue
                n = int(np.frombuffer(data, "<i4", 1)[0])
                if n <= 0 or len(data) % (4 * (n + 1)):
                    raise InvalidVector("not a file of equally long vectors")
                rows = np.frombuffer(data, "<i4").reshape(-1, n + 1)
                if (rows[:, 0] != n).any():
                    raise InvalidVector("vectors differ in length")
                for s in range(0, len(rows), 8192):
                    part = np.ascontiguousarray(rows[s : s + 8192, 1:]).view(kind)
                    offsets = np.arange(0, part.size + 1, n, dtype=np.int32)
                    yield pa.record_batch([pa.array(np.arange(s, s + len(part))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))], names=["id", "vector"])

    return files.mapInArrow(run, schema)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """id (row in its file), vector array<float>."""
    return _read(spark, path, "<f4", "id long, vector array<float>")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """id, vector array<int>."""
    return _read(spark, path, "<i4", "id long, vector array<int>")
