"""Maximum inner product search by score-aware anisotropic quantisation (operator 10).

Vectors are cut in parts of two dimensions with sixteen centres each, so a vector is two four-bit codes a byte, and a
factor that makes the coded vector's projection on the true one as long as that: the error along the vector, which counts
for large inner products, is then nil, whatever its length.  Centres are fitted on a bounded sample by alternating two steps on
the score-aware loss, which weighs the residual parallel to the (unit) vector ``eta`` times the orthogonal one: each vector's
codes are chosen part after part under that loss, then all centres are solved for at once.

What the coded direction leaves is kept in 16-bit steps of the row's own, with the length of what these leave in turn: a
bound of the error of every inner product with that row.

1. Equal vectors are folded to one, with the smallest ids that any query can ask for.  Every different vector is encoded
   once and stored packed; from here on only codes travel, not vectors.
2. Queries meet blocks of codes (a stated query set against all rows).  A query's products with a block's decoded rows, less
   and plus their bounds, tell which rows may be among its ``k``: all whose upper bound reaches the lower bound of the
   k-th best are passed on, and of those of all blocks the ones that reach the k-th best of all.  No number cuts them.
3. Those vectors are fetched by a join and scored exactly, in double precision, as they came; copies come back after
   that, smaller vec_ids first, so groups of copies of any size shut nothing out and give the right ids.

So every one of the nearest rows is found, however the rows lie; where the codes tell less, more rows are scored.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors meet those of their
own length only, each length with centres of its own; a null vec_id takes no part; repeated vec_ids are candidates each but for queries of that id,
and a repeated query id answers once for each different vector, its best rows together; ties go to the smaller vec_id; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, stored

PART, CENTRES = 2, 16
TILE, BLOCK_BYTES = 1 << 22, 1 << 25  # components that are decoded at once; bytes of codes in a block
FOUND = "query long, need int, h1 long, h2 long, low double, high double"


@dataclass
class Codebook:
    centres: np.ndarray  # parts x 16 x 2
    eta: float

    def encode(self, x: np.ndarray, passes: int = 1) -> np.ndarray:
        """Codes under the score-aware loss, by coordinate descent over the parts; one byte a code."""
        return np.concatenate([np.empty((0, len(self.centres)), np.uint8), *(self._encode(x[k : k + 1024], passes) for k in range(0, len(x), 1024))])

    def _encode(self, x: np.ndarray, passes: int) -> np.ndarray:
        n, parts = len(x), len(self.centres)
        cut = _cut(x, parts)
        unit = _cut(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30), parts)
        code = np.empty((n, parts), np.uint8)
        residual = np.empty((n, parts), np.float32)  # each part's share of the parallel residual
        at = np.arange(n)
        errors, shifts = [], []
        for p, centres in enumerate(self.centres):
            errors.append((centres**2).sum(1) - 2 * (cut[:, p] @ centres.T))  # less the square of the part itself
            shifts.append((cut[:, p] * unit[:, p]).sum(1, keepdims=True) - unit[:, p] @ centres.T)
            code[:, p] = errors[p].argmin(1)
            residual[:, p] = shifts[p][at, code[:, p]]
        along = residual.sum(1)
        for _ in range(passes):
            for p in range(parts):
                other = along - residual[:, p]
                loss = errors[p] + (self.eta - 1) * (shifts[p] + other[:, None]) ** 2
                code[:, p] = loss.argmin(1)
                residual[:, p] = shifts[p][at, code[:, p]]
                along = other + residual[:, p]
        return code


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    short = parts * PART - x.shape[1]
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), parts, PART).astype(np.float32)


def fit(sample: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 5) -> Codebook:
    """Centres for the score-aware loss; ``threshold`` is the cosine above which scores matter, which sets eta."""
    n, dim = sample.shape
    parts = -(-dim // PART)
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    cut, rng = _cut(sample, parts), np.random.default_rng(seed)
    first = rng.permutation(n)[:CENTRES]
    centres = cut[np.resize(first, CENTRES)].transpose(1, 0, 2).copy()
    for _ in range(rounds):  # plain start, part by part
        for p in range(parts):
            near = ((cut[:, p, None] - centres[p]) ** 2).sum(2).argmin(1)
            for c in range(CENTRES):
                if (near == c).any():
                    centres[p, c] = cut[near == c, p].mean(0)
    book = Codebook(centres, eta)
    unit = _cut(sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30), parts)
    for _ in range(rounds // 2):
        code = book.encode(sample)
        # normal equations of sum |x - c|^2 + (eta - 1) (u . (x - c))^2 over all centres at once
        size = parts * CENTRES * PART
        a, b = np.eye(size) * 1e-6, np.zeros(size)
        column = ((np.arange(parts) * CENTRES + code) * PART)[:, :, None] + np.arange(PART)
        for begin in range(0, n, 512):
            col, u, x = column[begin : begin + 512].reshape(-1, parts * PART), unit[begin : begin + 512].reshape(-1, parts * PART), cut[begin : begin + 512].reshape(-1, parts * PART)
            np.add.at(a, (col, col), 1.0)
            np.add.at(b, col, x)
            dense = np.zeros((len(col), size), np.float32)
            np.put_along_axis(dense, col, u, 1)
            a += (eta - 1) * (dense.T @ dense)
            b += (eta - 1) * (dense * (u * x).sum(1, keepdims=True)).sum(0)
        book.centres = np.linalg.solve(a, b).reshape(parts, CENTRES, PART).astype(np.float32)
    return book


def pack(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if code.shape[1] % 2:
        code = np.concatenate((code, np.zeros((len(code), 1), np.uint8)), 1)
    return code[:, ::2] | code[:, 1::2] << 4


def unpack(packed: np.ndarray, parts: int) -> np.ndarray:
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :parts]


def coded(book: Codebook, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the vectors' directions, and the factor of each: its length over the coded direction's projection on it."""
    size = np.linalg.norm(x.astype(np.float64), axis=1)
    unit = (x / np.maximum(size, 1e-300)[:, None]).astype(np.float32)
    code = book.encode(unit)
    parts = len(book.centres)
    near = book.centres[np.arange(parts)[None, :], code]
    along = (near * _cut(unit, parts)).sum((1, 2)).astype(np.float64)
    return code, np.where(along > 0.1, size / np.maximum(along, 0.1), size).astype(np.float32)


def scan(queries: np.ndarray, codes: np.ndarray, centres: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Estimated inner products of each query and row, from sums of 8-bit table entries."""
    parts = len(centres)
    tables = np.einsum("qpd,pcd->qpc", _cut(queries, parts), centres)
    low = tables.min(2, keepdims=True)
    scale = np.maximum((tables - low).max((1, 2)), 1e-30) / 255
    small = np.rint((tables - low) / scale[:, None, None]).astype(np.uint16)
    out = np.zeros((len(queries), len(codes)), np.uint16 if parts <= 256 else np.uint32)
    for p in range(parts):
        out += small[:, p].take(codes[:, p], axis=1)
    return (out * scale[:, None].astype(np.float32) + low.sum((1, 2))[:, None].astype(np.float32)) * factor


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths, in double precision."""
    x = x.astype(np.float64)
    top = np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(np.float64).tiny)
    size = np.linalg.norm(x / top, axis=1, keepdims=True)
    return x / top / np.maximum(size, 1e-300), (size * top)[:, 0]


def packed_rows(book: Codebook, x: np.ndarray) -> np.ndarray:
    """A row's bytes: codes of its direction, residual in 16-bit steps; factor, step, length of the row, bound of the error (doubles)."""
    unit, size = directions(x)
    code, factor = coded(book, unit.astype(np.float32))
    rest = unit - _near(book.centres, code, factor.astype(np.float64), x.shape[1])
    step = np.maximum(np.abs(rest).max(1) / 32767, 1e-300)
    fine = np.rint(rest / step[:, None]).astype("<i2")
    out = np.concatenate((pack(code), fine.view(np.uint8), np.stack((factor, step, size, size), 1).astype("<f8").view(np.uint8)), 1)
    left = np.linalg.norm(unit - decoded(book.centres, out, x.shape[1])[0], axis=1)
    out[:, -8:] = (left * (1 + 1e-9) + 1e-15 * (x.shape[1] + 16))[:, None].astype("<f8").view(np.uint8)  # and what sums in doubles may lose
    return out


def _near(centres: np.ndarray, code: np.ndarray, factor: np.ndarray, dim: int) -> np.ndarray:
    return centres[np.arange(len(centres))[None, :], code].reshape(len(code), -1)[:, :dim] * factor[:, None]


def decoded(centres: np.ndarray, rows: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions as coded, lengths, and bounds of the error of their products with unit vectors."""
    cut = rows.shape[1] - 32 - 2 * dim
    factor, step, size, left = np.ascontiguousarray(rows[:, -32:]).view("<f8").T
    fine = np.ascontiguousarray(rows[:, cut:-32]).view("<i2")
    return _near(centres, unpack(rows[:, :cut], len(centres)), factor, dim) + fine * step[:, None], size, left


def exact_scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added in order: equal vectors score equally."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += rows[:, d].astype(np.float64) * q[..., d].astype(np.float64)
    return out


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def _matrix(column) -> np.ndarray:
    if not len(column):
        return np.empty((0, 1), np.float32)
    flat = column.flatten()
    kind = np.float64 if pa.types.is_float64(flat.type) else np.float32
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def fold(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Different vectors (h1, h2, embedding), and the ``k`` + 1 smallest ids of each (h1, h2, vec_id, n: how often the row is there)."""
    plain = F.transform("embedding", lambda x: x + 0)  # negative zeros become zeros
    marked = rows.select(F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(37), plain).alias("h2"), "vec_id", plain.alias("embedding"))
    marked, _ = stored(marked, "vectors")
    vectors = marked.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = marked.groupBy("h1", "h2", "vec_id").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    return vectors, ids


def _encoded(vectors: DataFrame, book) -> DataFrame:
    """h1, h2, codes (``packed_rows``)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                flat = packed_rows(book.value, _matrix(b.column(2)))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
                yield pa.record_batch([b.column(0), b.column(1), packed], names=["h1", "h2", "codes"])

    return vectors.select("h1", "h2", "embedding").mapInArrow(run, "h1 long, h2 long, codes binary")


def _candidates(queries: DataFrame, codes: DataFrame, book, dim: int, blocks: int, chunks: int) -> DataFrame:
    """FOUND: each block's rows that may be among the ``need`` best of a query, with bounds of their products with its direction."""
    block = F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64("query", F.lit(4)), F.lit(chunks)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    left = queries.select(chunk.alias("chunk"), spread(blocks).alias("block"), F.lit(0).alias("side"), F.col("query").alias("h1"), F.lit(0).cast("long").alias("h2"), none("binary").alias("codes"), "need", "embedding")
    right = codes.select(spread(chunks).alias("chunk"), block.alias("block"), F.lit(1).alias("side"), "h1", "h2", "codes", F.lit(0).alias("need"), none(queries.schema["embedding"].dataType.simpleString()).alias("embedding"))
    dealt = left.unionAll(right).repartition(min(blocks * chunks, 4096), "block", "chunk").sortWithinPartitions("block", "chunk", "side", "h1", "h2")

    def run(batches):
        for ids, needs, vectors, h1, h2, packed in _cells(batches):
            if not len(ids) or not len(h1):
                continue
            tile = max(1024, TILE // dim)
            for start in range(0, len(h1), tile):
                own1, own2 = h1[start : start + tile], h2[start : start + tile]
                rows, size, left = decoded(book.value.centres, packed[start : start + tile], dim)
                for begin in range(0, len(ids), 64):
                    need = needs[begin : begin + 64]
                    low, high = _bounds(directions(vectors[begin : begin + 64])[0], rows, size, left)
                    q, r = np.nonzero(high >= _floor(low, need)[:, None])
                    for s in range(0, len(q), 1 << 19):  # batches of some 20 MB
                        a, b = q[s : s + (1 << 19)], r[s : s + (1 << 19)]
                        yield pa.record_batch([pa.array(x) for x in (ids[begin + a], need[a].astype(np.int32), own1[b], own2[b], low[a, b], high[a, b])], names=["query", "need", "h1", "h2", "low", "high"])

    return dealt.mapInArrow(run, FOUND)


def _bounds(asked: np.ndarray, rows: np.ndarray, size: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner products of unit queries with the vectors that were coded."""
    near = asked @ rows.T
    return (near - left) * size, (near + left) * size


def _floor(low: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The lower bound that ``need`` rows of each query reach."""
    out, n = np.full(len(low), -np.inf), low.shape[1]
    for x in np.unique(need[need < n]):
        at = need == x
        out[at] = np.partition(low[at], n - x, axis=1)[:, n - x]
    return out


def _cells(batches):
    """Runs of equal (block, chunk) over sorted batches: ids, needs and vectors of queries, then the hashes and codes of rows."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        block, chunk, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 0, 2))
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(block) != 0) | (np.diff(chunk) != 0)) + 1, [len(block)]))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if key is not None and key != (block[s], chunk[s]):
                yield _joined(held)
                held = []
            key = (block[s], chunk[s])
            held.append(_piece(b, int(s), int(s + (side[s:e] == 0).sum()), int(e)))
    if held:
        yield _joined(held)


def _piece(b, s: int, rows: int, e: int):
    part = b.slice(rows, e - rows)
    packed = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(e - rows, -1) if e > rows else None
    vectors = _matrix(b.column(7).slice(s, rows - s)) if rows > s else None
    return *(b.column(i).slice(s, rows - s).to_numpy() for i in (3, 6)), vectors, *(part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4)), packed


def _joined(held):
    parts = list(zip(*held, strict=True))
    return [np.concatenate([x for x in p if x is not None] or [np.empty(0)]) for p in parts]


def _rescored(found: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query, h1, h2, score: exact inner products of queries and the vectors that they name."""
    pairs = found.join(vectors, ["h1", "h2"]).join(queries.select("query", F.col("embedding").alias("asked")), "query")

    def run(batches):
        for b in batches:
            if b.num_rows:
                score = exact_scores(_matrix(b.column(4)), _matrix(b.column(3)))
                yield pa.record_batch([*(b.column(k) for k in range(3)), pa.array(score)], names=["query", "h1", "h2", "score"])

    return pairs.select("query", "h1", "h2", "embedding", "asked").mapInArrow(run, "query long, h1 long, h2 long, score double")


def search(rows: DataFrame, queries: DataFrame, k: int = 20, rerank: int = 0, sample_rows: int = 4000, block_rows: int = 65536, chunk_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to each query; both inputs as ``valid`` returns them.

    Scored exactly are all rows that may be among a query's ``k`` nearest, or among its ``rerank`` nearest if that is more.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    vectors, ids = fold(rows, k)
    vectors, _ = stored(vectors, "different")
    ids, _ = stored(ids, "ids")
    asked, _ = stored(queries.select("vec_id", F.transform("embedding", lambda x: x + 0).alias("embedding")).distinct(), "queries")
    # a query is told by its vector and its id, so repeated ids ask for each of their vectors
    asked = asked.withColumn("query", F.xxhash64("vec_id", "embedding"))
    # rows of a query's own id don't count
    own_rows = ids.groupBy("vec_id").agg(F.count("*").alias("own"))
    need = F.least(F.greatest(F.lit(k) + F.coalesce("own", F.lit(0)), F.lit(rerank)), F.lit(2**31 - 1)).cast("int")
    asked, _ = stored(asked.join(own_rows, "vec_id", "left").withColumn("need", need).drop("own"), "asked")
    parts = []
    for dim in sorted(r[0] for r in vectors.select(F.size("embedding")).distinct().collect()):
        some, own = vectors.where(F.size("embedding") == dim), asked.where(F.size("embedding") == dim)
        total, n = some.count(), own.count()
        if n:
            parts.append(_search_size(some, own, dim, total, n, sample_rows, block_rows, chunk_rows))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = parts[0]
    for p in parts[1:]:
        best = best.unionAll(p)
    best = best.join(ids, ["h1", "h2"]).join(asked.select("query", F.col("vec_id").alias("query_id")), "query").where("vec_id <> query_id")
    best = best.select("query_id", "score", "vec_id", F.explode(F.array_repeat(F.lit(0), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_size(vectors: DataFrame, queries: DataFrame, dim: int, total: int, n: int, sample_rows: int, block_rows: int, chunk_rows: int) -> DataFrame:
    """query, h1, h2, score of all candidates of each query, among vectors of one length."""
    spark = vectors.sparkSession
    sample = _matrix(vectors.orderBy(F.xxhash64("h1"), "h1", "h2").limit(sample_rows).select("embedding").toArrow().column(0).combine_chunks())
    book = spark.sparkContext.broadcast(fit((sample / np.maximum(np.linalg.norm(sample.astype(np.float64), axis=1, keepdims=True), 1e-300)).astype(np.float32)))
    codes, _ = stored(_encoded(vectors, book), "codes")
    width = -(-dim // (2 * PART)) + 2 * dim + 32
    blocks, chunks = max(12, -(-total // block_rows), -(-total * width // BLOCK_BYTES)), max(1, -(-n // chunk_rows))
    found = _candidates(queries, codes, book, dim, blocks, chunks)
    own = Window.partitionBy("query")
    found = found.withColumn("rank", F.row_number().over(own.orderBy(F.desc("low"), "h1", "h2")))
    found = found.withColumn("floor", F.min(F.when(F.col("rank") <= F.col("need"), F.col("low"))).over(own))
    found = found.where(F.col("high") >= F.col("floor")).select("query", "h1", "h2")
    return _rescored(found, queries, vectors)


def op10_ann(spark, sf_dir: str) -> DataFrame:
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))


#: Exact nearest rows.
OP10_SQL = """
WITH rows AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_reduce(list_transform(list_zip(r.v, q.v), lambda p: p[1] * p[2]), lambda a, b: a + b) + 0.0 AS score
  FROM rows q, rows r WHERE q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id AND len(q.v) = len(r.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""
