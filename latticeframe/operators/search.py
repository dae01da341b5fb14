"""Nearest neighbours on quantised vectors.

Tables need ``id``, ``codes`` (array of tinyint), ``nn`` (squared norm of the codes) and, for distances, ``scale``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidVector
from ..functions import vector as V

TILE = 1 << 20  # scores, or components of codes, that a worker holds at once


def quantized(nodes: DataFrame, vector: str = "embedding") -> DataFrame:
    """Replaces a float vector column by codes, scale and nn."""
    scaled = nodes.withColumn("scale", V.scale_of(F.col(vector)))
    coded = scaled.withColumn("codes", V.codes_of(F.col(vector), F.col("scale")))
    return coded.withColumn("nn", V.square_norm(F.col("codes"))).drop(vector)


def check_query(vector: list[float], dimension: int | None) -> None:
    if not vector or not all(np.isfinite(vector)):
        raise InvalidVector("a query vector is non-empty and finite")
    if dimension is not None and len(vector) != dimension:
        raise DimensionMismatch(f"{len(vector)} components against {dimension}")


def scored(nodes: DataFrame, query: list[float], metric: str = "cosine") -> DataFrame:
    """Adds ``score`` against one query vector: a projection, no shuffle."""
    codes, scale = V.quantize(query)
    if metric == "cosine":
        dot = V.dot_codes(F.col("codes"), V.literal_codes(codes))
        return nodes.withColumn("score", V.cosine(dot, F.col("nn"), F.lit(sum(c * c for c in codes))))
    if metric == "l2":
        return nodes.withColumn("score", V.l2_score(F.col("codes"), F.col("scale"), V.literal_codes(codes), F.lit(scale)))
    raise InvalidVector(f"unknown metric {metric}")


def nearest(nodes: DataFrame, query: list[float], k: int, metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """The k best rows by score, rounded to ``digits`` if given, then id: one scan and a top-k merge."""
    score = F.col("score") if digits is None else (F.round("score", digits) + 0.0).alias("score")
    return scored(nodes, query, metric).select("id", score).orderBy(F.desc("score"), "id").limit(k)


def threshold_scan(nodes: DataFrame, query: list[float], least: float) -> DataFrame:
    """All rows with a cosine of at least ``least``."""
    return scored(nodes, query).where(F.col("score") >= least).select("id", "score")


def nearest_join(nodes: DataFrame, queries: DataFrame, k: int, query_bytes: int = 1 << 25) -> DataFrame:
    """The k best rows for each query: query_id, id, dot, score.

    Query codes are broadcast, as bytes, only up to ``query_bytes``; more queries are dealt in chunks of that size
    against all rows, a chunk a pass.  Rows are scored as integer matrix products over Arrow batches, in tiles of TILE
    scores, so a worker's memory depends neither on the rows nor on the queries; each batch passes on its own k best, so
    what is shuffled is k rows a query and batch.
    """
    size = queries.agg(F.sum(F.size("codes") + 16)).first()[0] or 0
    chunks = max(1, -(-size // query_bytes))
    out = None
    for c in range(chunks):
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c) if chunks > 1 else queries
        part = _join_chunk(nodes, some, k)
        out = part if out is None else out.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "dot", "score")


def _join_chunk(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = nodes.sparkSession
    table = queries.select("id", "codes", "nn").toArrow()
    if table.num_rows == 0:
        return spark.createDataFrame([], "query_id long, id long, dot long, score double")
    shared = spark.sparkContext.broadcast((table.column("id").to_numpy(), _codes(table.column("codes").combine_chunks()), table.column("nn").to_numpy()))

    def run(batches):
        qid, q, qn = shared.value
        names, held, count = ["query_id", "id", "dot", "score"], [], 0
        for ids, codes, nn in _tiles(batches, q.shape[1]):
            step = max(1, TILE // len(ids))
            for s in range(0, len(qid), step):
                dot = q[s : s + step].astype(np.float64) @ codes.T  # exact: far below 2**53
                root = np.sqrt(qn[s : s + step].astype(np.float64))[:, None] * np.sqrt(nn.astype(np.float64))
                score = np.divide(dot, root, out=np.zeros(dot.shape), where=root > 0)
                of, at = _top(score, k)
                held.append(pa.record_batch([pa.array(qid[s + of]), pa.array(ids[at]), pa.array(dot[of, at].astype(np.int64)), pa.array(score[of, at])], names=names))
                count += len(of)
                if count >= 1 << 16:
                    yield pa.concat_batches(held)
                    held, count = [], 0
        if held:
            yield pa.concat_batches(held)

    return nodes.select("id", "codes", "nn").mapInArrow(run, "query_id long, id long, dot long, score double")


def _codes(column) -> np.ndarray:
    """Codes as a matrix of bytes."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tiles(batches, dimension: int):
    """ids, codes (doubles) and nn of rows in order of their ids, at most TILE components at a time."""
    rows = max(256, TILE // max(1, dimension))
    for whole in batches:
        for begin in range(0, whole.num_rows, rows):
            b = whole.slice(begin, rows)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            by_id = np.argsort(ids, kind="stable")
            yield ids[by_id], _codes(b.column(1))[by_id].astype(np.float64), b.column(2).to_numpy(zero_copy_only=False)[by_id]


def _top(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row by score, then smaller column."""
    n = score.shape[1]
    if n > k:
        of, at = np.nonzero(score >= np.partition(score, n - k, axis=1)[:, n - k : n - k + 1])
    else:
        of, at = np.nonzero(np.ones(score.shape, bool))
    order = np.lexsort((at, -score[of, at], of))
    of, at = of[order], at[order]
    first = np.arange(len(of)) - np.searchsorted(of, of) < k  # ties of the k-th beyond it go
    return of[first], at[first]


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Share of the exact neighbours that were found, by query: query_id, recall."""
    hit = exact.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return exact.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("recall"))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centres of a sample of vectors by their directions."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)
    centres = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres[filled] = total[filled]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    return centres


def cells_for(rows: int) -> int:
    """Cells grow with the root of the rows, to 4,096 at most."""
    return max(1, min(4096, int(rows**0.5)))


def probes_for(cells: int) -> int:
    """Cells that a search reads by default: a quarter of few, sixty-four of many."""
    return min(cells, max(4, min(64, cells // 2)))


def nearest_cells(centres: np.ndarray, query, probes: int) -> list[int]:
    return np.argsort(-(centres @ np.asarray(query, np.float32)), kind="stable")[:probes].tolist()


def with_cells(nodes: DataFrame, centres: np.ndarray, vector: str) -> DataFrame:
    """``nodes`` with the cell of each vector: its nearest centre."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            near = [(x @ shared.value.T).argmax(1) for x in _stacks(v, len(shared.value))]
            yield pd.Series(np.concatenate(near) if near else [], dtype="int32")

    return nodes.withColumn("cell", F.pandas_udf(assign, "int")(F.col(vector)))


def _stacks(vectors: pd.Series, cells: int) -> Iterator[np.ndarray]:
    """Vectors as matrices, with at most TILE products with the cells' centres at a time."""
    rows = max(1, TILE // max(1, cells))
    for begin in range(0, len(vectors), rows):
        yield np.stack(vectors.iloc[begin : begin + rows].to_list())


class CellIndex:
    """Approximate search: rows are grouped by their nearest centre, stored partitioned by cell.

    There are as many centres as ``cells_for`` says, fitted on a sample of at most ``sample_rows``.  ``search`` reads only the
    ``probes`` cells nearest to the query (partition pruning), then ranks their rows exactly.
    """

    def __init__(self, centres: np.ndarray, path: str, vector: str = "embedding"):
        self.centres, self.path, self.vector = centres, path, vector

    @classmethod
    def build(cls, nodes: DataFrame, path: str, vector: str = "embedding", cells: int | None = None, sample_rows: int = 20_000, seed: int = 3) -> CellIndex:
        sample = nodes.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select(vector).toArrow()
        cells = cells_for(nodes.count()) if cells is None else cells
        centres = fit_centres(np.array(sample.column(0).to_pylist(), np.float32), cells, seed=seed)
        index = cls(centres, path, vector)
        index.insert(nodes)
        return index

    def insert(self, nodes: DataFrame) -> None:
        """Adds rows (id and the vector) to the cells of the same centres."""
        quantized(with_cells(nodes.select("id", self.vector), self.centres, self.vector), self.vector).write.mode("append").partitionBy("cell").parquet(self.path)

    def search(self, spark, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        cells = nearest_cells(self.centres, query, probes or probes_for(len(self.centres)))
        return nearest(spark.read.parquet(self.path).where(F.col("cell").isin(cells)), list(query), k)

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, id, score: the k best rows of the cells nearest to each query (id and the vector), by one join on the cell."""
        spark = queries.sparkSession
        shared, n = spark.sparkContext.broadcast(self.centres), probes or probes_for(len(self.centres))

        def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                near = (np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32) for x in _stacks(v, len(shared.value)))
                yield pd.Series([row for x in near for row in x])

        asked = quantized(queries.withColumn("cells", F.pandas_udf(cells, "array<int>")(F.col(self.vector))), self.vector)
        asked = asked.select(F.col("id").alias("query_id"), F.col("codes").alias("q_codes"), F.col("nn").alias("q_nn"), F.explode("cells").alias("cell"))
        both = asked.join(spark.read.parquet(self.path), "cell")
        scored_ = both.select("query_id", "id", V.cosine(V.dot_codes(F.col("codes"), F.col("q_codes")), F.col("nn"), F.col("q_nn")).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return scored_.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
