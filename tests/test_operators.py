from __future__ import annotations

import math
import struct
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeframe.functions import vector as V
from latticeframe.operators import graph, hybrid, search, temporal
from latticeframe.operators.quantiles import percentiles
from latticeframe.sources.vecs import read_fvecs, read_ivecs


def test_l2_ranking(spark):
    x = np.random.default_rng(41).normal(size=(60, 6)).astype(np.float32)
    rows = search.quantized(spark.createDataFrame(list(enumerate(x.tolist())), "id long, embedding array<float>"))
    code = [(np.array(c, float), s) for c, s in map(V.quantize, x.tolist())]
    far = [float(((c * s - code[11][0] * code[11][1]) ** 2).sum()) for c, s in code]
    assert [r.id for r in search.nearest(rows, x[11].tolist(), 20, "l2").collect()] == sorted(range(60), key=lambda k: (far[k], k))[:20]


def test_driver_and_column_quantisers_agree(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=16).astype(np.float32).tolist() for _ in range(200)] + [[0.0] * 16, [0.5, -0.5] * 8]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "id int, embedding array<float>")
    got = {r.id: (list(r.codes), r.scale) for r in search.quantized(df).select("id", F.col("codes").cast("array<int>").alias("codes"), "scale").collect()}
    assert got == {k: V.quantize(v) for k, v in enumerate(vectors)}


def test_nearest_join_breaks_ties_by_id(spark):
    rows = search.quantized(spark.createDataFrame([(k, [1.0, float(k % 2)]) for k in range(300)], "id long, embedding array<float>"))
    got = search.nearest_join(rows, rows.where("id < 2"), 5).orderBy("query_id", F.desc("score"), "id").collect()
    assert [r.id for r in got] == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    chunked = search.nearest_join(rows, rows.where("id < 2"), 5, query_bytes=1).orderBy("query_id", F.desc("score"), "id").collect()
    assert chunked == got


class Local:
    """Stands for a table and its session, and hands back the function that runs over its batches."""

    def __init__(self, batch=None):
        self.batch, self.sparkSession, self.sparkContext = batch, self, self

    def broadcast(self, value):
        return type("Shared", (), {"value": value})

    def select(self, *columns):
        return self

    def toArrow(self):
        return pa.Table.from_batches([self.batch])

    def mapInArrow(self, run, kind):
        return run


def coded_rows(n):
    codes = np.random.default_rng(n).integers(-9, 10, (n, 8)).astype(np.int8)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 8, pa.int32()), pa.array(codes.ravel()))
    return codes.astype(np.int64), pa.record_batch([pa.array(np.arange(n)[::-1]), lists, pa.array((codes.astype(np.int64) ** 2).sum(1))], names=["id", "codes", "nn"])


def test_nearest_join_holds_a_tile_at_a_time():
    (q, asked), (x, rows) = coded_rows(1500), coded_rows(10_000)
    run = search._join_chunk(Local(), Local(asked), 5)
    tracemalloc.start()
    out = list(run([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores of 1,024 queries take 82 MB, and were held several times
    got = pa.Table.from_batches(out).to_pandas()
    for k in (0, 700, 1499):
        dot = x @ q[k]
        score = np.where((x**2).sum(1) > 0, dot / np.maximum(np.sqrt((q[k] ** 2).sum()) * np.sqrt((x**2).sum(1)), 1e-300), 0)
        mine = got[got.query_id == 1499 - k]
        assert mine.id.tolist() == (9999 - np.lexsort((9999 - np.arange(10_000), -score))[:5]).tolist()
        assert mine["dot"].tolist() == [int(dot[9999 - i]) for i in mine.id]


def test_walk_passes_through_what_is_filtered(spark):
    nodes = spark.createDataFrame([(k,) for k in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (1, 2, 1), (2, 0, 1), (2, 9, 1), (2, 3, 2)], "src long, dst long, edge_type int")
    start = nodes.where("id = 0")
    found = graph.traverse(nodes, edges, start, 5, keep=F.col("id") != 1).orderBy("id").collect()
    assert [(r.id, r.depth) for r in found] == [(0, 0), (2, 2), (3, 3)]
    assert {r.id for r in graph.reachable(nodes, edges, start, 5, 1).collect()} == {0, 1, 2}
    assert [r.id for r in graph.reachable(nodes, edges, start, 0).collect()] == [0]


def test_point_within_needs_one_point_for_both_bounds(spark):
    rows = spark.createDataFrame([(1, [(1, 9), (9, 1)]), (2, [(1, 1)]), (3, [])], "id int, points array<struct<assertion_time:long,valid_time:long>>")
    assert [r.id for r in rows.where(hybrid.point_within(F.col("points"), 5, 5)).collect()] == [2]


RECORDS = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5), st.integers(1, 4), st.integers(0, 3)), max_size=12)


@settings(max_examples=5, deadline=None)
@given(RECORDS, st.integers(0, 8), st.integers(0, 3))
def test_as_of_against_brute_force(spark, rows, at, known):
    facts = [(k, f"v{n}", a, a + w, e) for n, (k, a, w, e) in enumerate(rows)]
    df = spark.createDataFrame(facts, "key int, value string, valid_from long, valid_to long, asserted_at long")
    live = [f for f in facts if f[0] == 0 and f[2] <= at < f[3] and f[4] <= known]
    got = temporal.get_as_of(df, 0, at, known).collect()
    if not live:
        assert got == []
    else:
        best = min((-f[4], f[2], f[3]) for f in live)
        assert (-got[0].asserted_at, got[0].valid_from, got[0].valid_to) == best
    probes = spark.createDataFrame([(7, 0, at, known)], "probe_id int, key int, at long, known_by long")
    joined = temporal.as_of_join(probes, df).collect()
    assert [(r.valid_from, r.valid_to, r.asserted_at) for r in joined] == [(r.valid_from, r.valid_to, r.asserted_at) for r in got]


def joined_rows(df) -> list[int]:
    """Rows that each join of an executed plan put out."""
    def walk(p):  # noqa: E306
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        own = [p.metrics().apply("numOutputRows").value()] if kind.endswith("JoinExec") else []
        return own + [n for i in range(p.children().length()) for n in walk(p.children().apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def test_as_of_join_meets_ranges_not_records(spark):
    records = spark.range(0, 6000, 1, 4).selectExpr("'k' AS key", "CAST(id AS string) AS value", "id % 3 * 10 AS valid_from", "id % 3 * 10 + 20 AS valid_to", "id AS asserted_at")
    probes = spark.range(0, 6000, 1, 4).selectExpr("id AS probe_id", "'k' AS key", "id % 40 AS at", "id - 1 AS known_by")
    df = temporal.as_of_join(probes, records)
    got = {r.probe_id: (r.value, r.valid_from, r.asserted_at) for r in df.collect()}
    want = {}
    for n in range(6000):
        known = [k for k in range(max(0, n - 6), n) if k % 3 * 10 <= n % 40 < k % 3 * 10 + 20]
        if known:
            want[n] = (str(known[-1]), known[-1] % 3 * 10, known[-1])
    assert got == want
    rows = joined_rows(df)
    assert rows and sum(rows) <= 3 * 6000  # two ranges a probe, not 4,000 records


def test_as_of_join_takes_null_values_and_types(spark):
    records = spark.createDataFrame([(1, None, 0, 9, 3), (1, [1], 0, 9, 1), (None, [2], 0, 9, 1), (2, [3], 0, 9, None), (2, [4], 5, 5, 1)], "key int, value array<int>, valid_from long, valid_to long, asserted_at long")
    probes = spark.createDataFrame([("a", 1, 4, 3), ("b", 1, 4, 2), ("c", 1, 4, 0), ("d", None, 4, 9), ("e", 2, 5, 9), ("f", 1, 9, 9), ("g", 1, 4, None)], "probe_id string, key int, at long, known_by long")
    got = sorted((r.probe_id, r.value, r.asserted_at) for r in temporal.as_of_join(probes, records).collect())
    assert got == [("a", None, 3), ("b", [1], 1)]


def test_vector_files(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i3f", 3, k, k + 0.5, -k) for k in range(5)))
    (tmp_path / "a.ivecs").write_bytes(b"".join(struct.pack("<i2i", 2, k, -k) for k in range(4)))
    assert [list(r.vector) for r in read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("id").collect()][2] == [2.0, 2.5, -2.0]
    assert [list(r.vector) for r in read_ivecs(spark, str(tmp_path / "a.ivecs")).orderBy("id").collect()] == [[k, -k] for k in range(4)]


def test_cell_index(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = np.eye(16, 64)
    x = (centres[np.arange(320) % 16] + 0.04 * rng.normal(size=(320, 64))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<float>")
    index, exact = search.CellIndex.build(df, str(tmp_path / "cells"), cells=64), search.quantized(df)
    asked = F.col("id") % 5 == 0
    got = search.recall(search.nearest_join(exact, exact.where(asked), 10), index.search_many(df.where(asked), 10, 4), 10).collect()
    assert len(got) == 64 and np.mean([r.recall for r in got]) >= 0.95  # four of 64 cells
    one = [r.id for r in index.search(spark, x[5].tolist(), 10, 4).collect()]
    assert one == [r.id for r in index.search_many(df.where("id = 5"), 10, 4).orderBy(F.desc("score"), "id").collect()]
    index.insert(spark.createDataFrame([(999, x[5].tolist())], "id long, embedding array<float>"))
    assert {r.id for r in index.search(spark, x[5].tolist(), 2, 1).collect()} == {5, 999}


def test_cells_of_a_batch_are_told_in_tiles():
    vectors = pd.Series(list(np.random.default_rng(2).normal(size=(3000, 4)).astype(np.float32)))
    parts = list(search._stacks(vectors, 4096))
    assert max(len(p) for p in parts) * 4096 <= search.TILE and (np.concatenate(parts) == np.stack(vectors.to_list())).all()
    assert list(search._stacks(vectors[:0], 4096)) == []


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-40, 40), st.sampled_from([1, 2, 7, 64, 2**62]), st.integers(0, 1)), max_size=14), st.lists(st.tuples(st.integers(0, 1), st.integers(-40, 40), st.sampled_from([1, 3, 30, 2**40]), st.integers(0, 1)), max_size=14))
def test_conflicts_against_brute_force(spark, ours, theirs):
    kind = "key int, value int, valid_from long, valid_to long, asserted_at long"
    ours, theirs = ({(k, a, a + w): v for k, a, w, v in rows} for rows in (ours, theirs))
    frame = lambda rows: spark.createDataFrame([(k, v, a, b, 1) for (k, a, b), v in rows.items()], kind)
    want = {(k, a, b) for (k, a, b), v in theirs.items() if any(k == x and a < d and c < b and v != u for (x, c, d), u in ours.items())}
    got = [(r.key, r.valid_from, r.valid_to) for r in temporal.conflicts(frame(theirs), frame(ours)).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("local", [10_000, 2])
def test_walks_of_either_size(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = np.random.default_rng(6)
    links = {(int(a), int(b)) for a, b in rng.integers(0, 60, (90, 2))} | {(1, 77)}
    nodes, edges = spark.range(60), spark.createDataFrame([(a, b, 1) for a, b in sorted(links)] * 2, "src long, dst long, edge_type int")
    want = set()
    for start in (1, 2, 3):
        front, seen = {start}, {start}
        want.add((start, start, 0))
        for h in range(1, 5):
            front = {b for a, b in links if a in front and b < 60} - seen
            seen |= front
            want |= {(start, k, h) for k in front}
    got = [tuple(r) for r in graph.reachable(nodes, edges, nodes.where("id IN (1, 2, 3)"), 4).select("start", "id", "depth").collect()]
    assert len(got) == len(want) and set(got) == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=40))
def test_percentiles_against_sorting(spark, values):
    got = percentiles(spark.createDataFrame([(v,) for v in values], "x int").repartition(3), "x", [0.01, 0.5, 0.9, 1.0]).first()
    real = sorted(v for v in values if v is not None)
    assert list(got) == [real[max(1, math.ceil(p * len(real))) - 1] if real else None for p in (0.01, 0.5, 0.9, 1.0)]


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10**6))
def test_both_access_paths_agree_with_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 12
    x = rng.normal(size=(n, 4)).astype(np.float32).tolist()
    points = [[(int(a), int(v)) for a, v in rng.integers(0, 10, (rng.integers(0, 3), 2))] for _ in range(n)]
    links = {(int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, n, 30), rng.integers(0, n + 2, 30), rng.integers(0, 2, 30), strict=True)}
    nodes = search.quantized(spark.createDataFrame([(k, x[k], points[k]) for k in range(n)], "id long, embedding array<float>, points array<struct<assertion_time:long,valid_time:long>>"))
    edges = spark.createDataFrame(sorted(links), "src long, dst long, edge_type int")
    hops, kind = int(rng.integers(0, 4)), [None, 0, 1][rng.integers(0, 3)]
    depth, front = {0: 0}, {0}
    for h in range(1, hops + 1):
        front = {b for a, b, t in links if a in front and b < n and kind in (None, t)} - set(depth)
        depth |= dict.fromkeys(front, h)
    code = [V.quantize(v)[0] for v in x]
    q, _ = V.quantize(x[0])

    def cosine(k):
        a, b = sum(c * c for c in code[k]), sum(c * c for c in q)
        return sum(c * d for c, d in zip(code[k], q, strict=True)) / (a**0.5 * b**0.5)

    want = sorted(((-cosine(k), d, k) for k, d in depth.items() if cosine(k) >= -0.2 and any(a < 7 and v <= 6 for a, v in points[k])))
    start = nodes.where("id = 0").select("id")
    for path in (hybrid.graph_first, hybrid.vector_first):
        got = [(r.id, r.depth) for r in path(nodes, edges, start, x[0], -0.2, 7, 6, hops, kind).collect()]
        assert got == [(k, d) for _, d, k in want]
