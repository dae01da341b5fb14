"""Topics for the mixing operator: clusters of texts by the words they hold.

A text is a vector of the square roots of its word counts over ``BUCKETS`` hashed words, less the mean text's and of length
one.  Centres are fitted by spherical k-means on every row that has words, each with its whole text: the vectors are written
once to the shared folder, and each step is a pass over them.  Every row is then given its nearest centre.

Vectors and centres are whole numbers in units of 1 / ``ONE``, so sums and products are exact: neither the order of the rows
nor how they are dealt changes a centre, and equal texts have equal topics.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textsets as ts
from ._shared import remove, stored

BUCKETS, ONE = 1024, 1 << 20
ROWS = 128  # texts that are worked on at a time
PARTS = 64  # partial results that are merged on the driver; more are merged by tasks first

PRODUCT = 1 << 18  # multiplications of a matrix product that BLAS does without threads of its own, which wait busily

#: Some texts as vectors: how many buckets each has, those buckets, and the values there.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]
KINDS = ("<i4", "<u2", "<u4")


def vectors(texts: list[bytes | None]) -> tuple[Rows, np.ndarray]:
    """Texts at length ONE (nothing without words), and how many words each has."""
    w, at = ts.words(texts)
    words = np.diff(at)
    place = np.repeat(np.arange(len(texts)), words) * BUCKETS + (w & np.uint64(BUCKETS - 1)).astype(np.int64)
    table = np.bincount(place, minlength=len(texts) * BUCKETS)
    held = np.flatnonzero(table)
    row = held // BUCKETS
    value = np.rint(np.sqrt(table[held] / words[row]) * ONE)
    return tuple(c.astype(kind) for c, kind in zip((np.bincount(row, minlength=len(texts)), held % BUCKETS, value), KINDS, strict=True)), words


def _dense(rows: Rows) -> np.ndarray:
    sizes, bucket, value = rows
    x = np.zeros(len(sizes) * BUCKETS)
    x[np.repeat(np.arange(0, len(x), BUCKETS), sizes) + bucket] = value
    return x.reshape(len(sizes), BUCKETS)


def _centred(rows: Rows, mean: np.ndarray) -> np.ndarray:
    """``rows`` less ``mean``, at length ONE."""
    x = _dense(rows)
    x -= mean
    x *= (ONE / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1))[:, None]
    return np.rint(x, out=x)


def _products(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, PRODUCT // max(1, centres.size))
    return np.concatenate([x[k : k + step] @ centres.T for k in range(0, len(x), step)])


def _total(rows: Rows) -> np.ndarray:
    """The sum of the rows, and in one more place their number."""
    return np.append(np.bincount(rows[1], rows[2], BUCKETS), len(rows[0])).astype(np.int64)


def _furthest(rows: Rows, mean: np.ndarray, centres: np.ndarray) -> tuple[int, bytes, bytes]:
    """How near the row that is furthest from its nearest centre is, and that row; of equally far ones the first by its bytes."""
    near = _products(_centred(rows, mean), centres).max(1, initial=-(1 << 50))
    ends = np.cumsum(rows[0])
    return min((int(near[k]), *(c[ends[k] - rows[0][k] : ends[k]].tobytes() for c in rows[1:])) for k in np.flatnonzero(near == near.min()))


def _sums(rows: Rows, mean: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The sum of the rows of each centre."""
    x = _centred(rows, mean)
    own = _products(x, centres).argmax(1)
    return np.stack([x[own == k].sum(0) for k in range(len(centres))]).astype(np.int64)


def _steps(over: Callable, topics: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean text and the centres; starts are the texts furthest from those taken before, so nothing is random.

    ``over(step, merge)`` is what ``step`` gives for some rows at a time, merged over all rows in any order.
    """
    total = over(_total, np.add)
    if total is None:
        return np.zeros(BUCKETS), np.zeros((1, BUCKETS))
    mean, centres = np.rint(total[:-1] / total[-1]), np.zeros((0, BUCKETS))
    while len(centres) < topics:
        _, *start = over(lambda rows: _furthest(rows, mean, centres), min)
        bucket, value = (np.frombuffer(b, kind) for b, kind in zip(start, KINDS[1:], strict=True))
        start = _centred((np.array([len(value)]), bucket, value), mean)
        if (centres == start).all(1).any():  # there are no more different texts
            break
        centres = np.concatenate((centres, start))
    for _ in range(rounds):
        sums = over(lambda rows: _sums(rows, mean, centres), np.add).astype(float)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(length > 0, np.rint(sums * (ONE / np.maximum(length, 1))), centres)
        if (new == centres).all():
            break
        centres = new
    return mean, centres


def _merged(parts: Iterable, merge: Callable):
    out = None
    for p in parts:
        out = p if out is None else merge(out, p)
    return out


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _with_words(texts: list[bytes | None]) -> Rows:
    sizes, *held = vectors(texts)[0]
    return sizes[sizes > 0], *held


def fit(texts: list[str], topics: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The model of texts that are at hand: the same that ``fit_rows`` gives for a table of them."""
    held = [_with_words(_bytes(texts[k : k + ROWS])) for k in range(0, len(texts), ROWS)]
    return _steps(lambda step, merge: _merged((step(rows) for rows in held if len(rows[0])), merge), topics, rounds)


def fit_rows(documents: DataFrame, topics: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The model of all texts of ``documents``."""
    spark = documents.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in ts.text_batches(b.column(0), rows=ROWS):
                rows = _with_words(texts)
                if len(rows[0]):
                    yield pa.record_batch([pa.array([c.tobytes()]) for c in rows], names=["sizes", "bucket", "value"])

    kept, path = stored(documents.select("text").mapInArrow(write, "sizes binary, bucket binary, value binary"), "topics")
    tasks = kept.rdd.getNumPartitions()

    def over(step: Callable, merge: Callable):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = (columns for b in batches for columns in zip(*b.columns, strict=True))
            yield from _part(_merged((step(tuple(np.frombuffer(c.as_buffer(), kind) for c, kind in zip(columns, KINDS, strict=True))) for columns in held), merge))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _part(_merged((pickle.loads(x.as_py()) for b in batches for x in b.column(0)), merge))

        parts = kept.mapInArrow(run, "part binary")
        if tasks > PARTS:
            parts = parts.repartition(isqrt(tasks)).mapInArrow(again, "part binary")
        return _merged((pickle.loads(r.part) for r in parts.collect()), merge)

    model = _steps(over, topics, rounds)
    remove(spark, path)
    return model


def _part(out) -> Iterator[pa.RecordBatch]:
    if out is not None:
        yield pa.record_batch([pa.array([pickle.dumps(out)], pa.binary())], names=["part"])


def assign(model: tuple[np.ndarray, np.ndarray], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The topic of each text (``none`` without words) and its words."""
    names, words = [], [np.zeros(0, np.int64)]
    for k in range(0, len(texts), ROWS):
        rows, n = vectors(_bytes(texts[k : k + ROWS]))
        own = _products(_centred(rows, model[0]), model[1]).argmax(1)
        names += [f"t{c}" if some else "none" for c, some in zip(own, n, strict=True)]
        words.append(n)
    return names, np.concatenate(words)


def topic_and_tokens(documents: DataFrame, topics: int) -> Column:
    """A column (topic, n) over ``documents``: the topic and the words of a row's whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(fit_rows(documents, topics))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, n = assign(shared.value, texts.tolist())
            yield pd.DataFrame({"topic": names, "n": n})

    # nondeterministic, so that a join or a filter on the topic doesn't run it twice
    return F.pandas_udf(run, "topic string, n long").asNondeterministic()(F.col("text"))
