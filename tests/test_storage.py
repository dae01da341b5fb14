from __future__ import annotations

import glob
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeframe import errors
from latticeframe.functions.scalar import node_id_of
from latticeframe.functions.vector import quantize
from latticeframe.storage import Engine, KvCacheSpec, KvCacheStore, SessionManager
from latticeframe.storage.kvcache import CHUNK
from latticeframe.storage.log import CHECKPOINT
from latticeframe.storage.adapters import LayerMajorCacheAdapter, PagedCacheAdapter
from latticeframe.streaming.ingest import stream_records


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    yield e
    e.close()


def put(engine, branch, key, value, a=0, b=100, **options):
    t = engine.begin(branch)
    t.put(key, value, a, b)
    return t.commit(**options)


def value(engine, branch, key, at=50, known=None):
    found = engine.get_as_of(branch, key, at, known)
    return found and bytes(found["value"])


def test_a_fork_goes_its_own_way(engine):
    """Random writes to a parent and its fork, against two plain dictionaries."""
    rng = random.Random(17)
    main = engine.main_branch().id
    model, history = {}, {}
    for k in range(3):
        model[k] = f"start {k}".encode()
        put(engine, main, b"station-%d" % k, model[k], 0, 1000)
    history[engine.epoch] = dict(model)
    child = engine.fork(main).id
    models = {main: dict(model), child: dict(model)}
    for step in range(4):
        branch, k = rng.choice((main, child)), rng.randrange(5)
        models[branch][k] = f"{step} on {k}".encode()
        put(engine, branch, b"station-%d" % k, models[branch][k], 0, 1000)
    for branch, want in models.items():
        assert {k: value(engine, branch, b"station-%d" % k, 500) for k in range(5)} == {k: want.get(k) for k in range(5)}
    ((epoch, then),) = history.items()
    assert {k: value(engine, main, b"station-%d" % k, 500, known=epoch) for k in then} == then
    assert value(engine, main, b"station-0", 1000) is None and value(engine, main, b"station-0", 999) is not None


def test_stale_and_intervals(engine):
    main = engine.main_branch().id
    one, two = engine.begin(main), engine.begin(main)
    one.put(b"k", b"1", 0, 1)
    two.put(b"k", b"2", 0, 1)
    one.commit()
    with pytest.raises(errors.StaleTransaction):
        two.commit()
    with pytest.raises(errors.InvalidInterval):
        engine.begin(main).put(b"k", b"v", 5, 5)
    with pytest.raises(errors.UnknownBranch):
        engine.begin("nothing")


def test_merge(engine):
    main = engine.main_branch().id
    put(engine, main, b"tide", b"ebb", 40, 47)
    child = engine.fork(main).id
    put(engine, main, b"tide", b"slack", 47, 51)
    put(engine, child, b"tide", b"flood", 51, 58)
    put(engine, child, b"wind", b"north", 3, 90)
    assert engine.merge(main, child).applied_ranges == 2
    assert [value(engine, main, b"tide", t) for t in (46, 50, 55)] == [b"ebb", b"slack", b"flood"] and value(engine, main, b"wind", 3) == b"north"
    assert engine.merge(main, child).applied_ranges == 2  # the base stays where the branches forked


def test_a_conflicting_merge_takes_no_epoch(engine):
    """Random ranges in two siblings; the conflicts are those that brute force finds."""
    rng = random.Random(23)
    main = engine.main_branch().id
    branches, written = [engine.fork(main).id, engine.fork(main).id], []
    for branch in branches:
        t, own = engine.begin(branch), {}
        for _ in range(12):
            low = rng.randrange(200)
            own[rng.choice([b"x", b"y"]), low, low + rng.choice([1, 9, 70])] = bytes([rng.randrange(2)])
        for (key, low, high), v in own.items():
            t.put(key, v, low, high)
        t.commit()
        written.append(own)
    want = sum(any(k == k2 and a < b2 and a2 < b and v != v2 for (k2, a2, b2), v2 in written[0].items()) for (k, a, b), v in written[1].items())
    before = engine.epoch
    with pytest.raises(errors.MergeConflict) as e:
        engine.merge(*branches)
    assert e.value.ranges == want > 0 and engine.epoch == before
    grandchild = engine.fork(branches[1]).id
    with pytest.raises(errors.Invariant):
        engine.merge(branches[0], grandchild)


@pytest.mark.parametrize("fault", ["data", "before", "torn"])
def test_faults_leave_the_last_commit(spark, tmp_path, fault):
    path = str(tmp_path / "store")
    e = Engine(spark, path)
    main = e.main_branch().id
    put(e, main, b"k", b"old")
    with pytest.raises(errors.InjectedFault):
        put(e, main, b"k", b"new", fault=fault)
    if fault == "torn":
        with pytest.raises(errors.LogPoisoned):
            put(e, main, b"k", b"more")
    e.close()
    e = Engine(spark, path)
    assert value(e, main, b"k") == b"old"
    put(e, main, b"k", b"newer")
    assert value(e, main, b"k") == b"newer" and e.validate() == 2
    e.close()


def test_lock_and_corruption(spark, tmp_path):
    path = str(tmp_path / "store")
    e = Engine(spark, path)
    with pytest.raises(errors.DatabaseLocked):
        Engine(spark, path)
    put(e, e.main_branch().id, b"k", b"v")
    e.close()
    log = sorted(glob.glob(f"{path}/_log/*.json"))[0]
    damage(log, b"create", b"creatE")
    with pytest.raises(errors.CorruptLog):
        Engine(spark, path)


def damage(path, old, new):
    data = open(path, "rb").read()
    assert old in data
    open(path, "wb").write(data.replace(old, new))
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def test_a_dead_owners_lock_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "store")
    e = Engine(spark, path)
    put(e, e.main_branch().id, b"k", b"v")
    lock = f"{path}/_log/lock"
    for change in ({"pid": 2**22 + 5}, {"host": "elsewhere", "until": 0}):  # a process that is gone; a lease that has run out
        held = json.loads(open(lock).read()) | change
        for f in (lock, f"{path}/_log/.lock.crc"):
            os.remove(f)
        open(lock, "w").write(json.dumps(held))
        other = Engine(spark, path)
        with pytest.raises(errors.LogPoisoned):
            put(e, e.main_branch().id, b"k", b"late")
        assert value(other, other.main_branch().id, b"k") == b"v"
        e = other
    with pytest.raises(errors.DatabaseLocked):
        Engine(spark, path)
    e.close()
    assert not os.path.exists(lock)


def test_opening_reads_a_checkpoint_and_what_follows(spark, tmp_path):
    path = str(tmp_path / "store")
    e = Engine(spark, path)
    main = e.main_branch().id
    put(e, main, b"k", b"v")
    forks = [e.fork(main).id for _ in range(CHECKPOINT + 5)]
    put(e, forks[-1], b"k", b"own")
    want = {b.id: b for b in e.branches()}
    sizes = sorted(os.path.getsize(f) for f in glob.glob(f"{path}/_log/*.json"))
    assert sizes[-1] < 1000  # records hold what is new, not whole lists
    e.close()
    (checkpoint,) = glob.glob(f"{path}/_log/*.checkpoint")
    for broken in (False, True):
        if broken:
            damage(checkpoint, b'\\"epoch\\"', b'\\"epocH\\"')
        e = Engine(spark, path)
        assert {b.id: b for b in e.branches()} == want and value(e, forks[-1], b"k") == b"own" and value(e, main, b"k") == b"v"
        e.close()
    for f in sorted(glob.glob(f"{path}/_log/*.json"))[:3]:
        os.remove(f)
    with pytest.raises(errors.CorruptLog):  # without a whole checkpoint every commit is needed
        Engine(spark, path)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 99)), min_size=1, max_size=6))
def test_child_writes_never_reach_the_parent(engine, writes):
    main = engine.main_branch().id
    before = engine.records(main).count()
    child = engine.fork(main).id
    t = engine.begin(child)
    last = {}
    for k, v in writes:
        t.put(bytes([k]), bytes([v]), 0, 10)
        last[bytes([k])] = bytes([v])
    t.commit()
    assert engine.records(main).count() == before
    assert all(value(engine, child, k, 5) == v for k, v in last.items())


def grown_graph(engine, seed=31, n=30):
    """Random nodes, points and edges, and what a plain walk over them finds."""
    rng = np.random.default_rng(seed)
    ids = [node_id_of(f"buoy/{k}") for k in range(n)]
    vectors = rng.normal(size=(n, 5)).astype(np.float32).tolist()
    points = [[tuple(map(int, p)) for p in rng.integers(0, 60, (rng.integers(1, 3), 2))] for _ in range(n)]
    links = [[(int(t), int(k)) for t, k in zip(rng.integers(0, n, 5), rng.integers(3, 6, 5), strict=True)] for _ in range(n)]
    t = engine.begin(engine.main_branch().id)
    for k in range(n):
        t.put_node(f"buoy/{k}".encode(), points[k], vectors[k], [(ids[x], 0.5, e) for x, e in links[k]])
    t.commit()
    codes = [quantize(v)[0] for v in vectors]

    def walk(start, hops, kind):
        depth, front = {start: 0}, {start}
        for h in range(1, hops + 1):
            front = {x for k in front for x, e in links[k] if kind in (None, e)} - set(depth)
            depth |= dict.fromkeys(front, h)
        return depth

    def cosine(k, query):
        a, b = codes[k], quantize(query)[0]
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    return ids, vectors, points, walk, cosine


def test_three_way_query_by_both_paths(spark, tmp_path):
    m = SessionManager(spark, str(tmp_path / "store"))
    (ids, vectors, points, walk, cosine), main = grown_graph(m.engine), m.main_branch()
    query = ", ".join(map(repr, vectors[2]))
    for kind, hops, least, before, until in ((None, 4, 0.05, 50, 50), (4, 4, 0.0, 55, 55)):
        want = {ids[k]: d for k, d in walk(2, hops, kind).items() if cosine(k, vectors[2]) >= least and any(a < before and v <= until for a, v in points[k])}
        assert len(want) > 1
        edge = "" if kind is None else f"EDGE_TYPE = {kind}"
        text = f"MATCH (a)-[:EDGE*1..{hops}]->(b) FROM {ids[2].hex()} VECTOR [{query}] COSINE > {least} ASSERTION < {before} VALID <= {until} {edge} LIMIT 100"
        assert "GraphFirst" in m.explain(main, text) or "VectorFirst" in m.explain(main, text)
        got = m.query(main, text)
        assert {r["id"]: r["depth"] for r in got.to_pylist()} == want and [f.name for f in got.schema] == ["id", "score", "depth"]
        for path in ("GraphFirst", "VectorFirst"):
            rows = m.engine.hybrid(main, ids[2], vectors[2], least, before, until, hops, kind, path=path).collect()
            assert {bytes(r.id): r.depth for r in rows} == want
    assert "VectorFirst" in m.explain(main, text.replace(f"COSINE > {least}", "COSINE > 0.99"))
    with pytest.raises(errors.UnknownNode):
        m.query(main, text.replace(ids[2].hex(), "00" * 32))
    with pytest.raises(errors.DimensionMismatch):
        m.query(main, "VECTOR NEAREST [1.0] LIMIT 2")
    assert m.export_fused(main).count() == len(ids)
    # a condition over node, depth and score, and the lookup of one node
    found = m.engine.traverse(main, ids[2], vectors[2], 3, keep=(F.col("depth") >= 1) & (F.col("score") < 0.5) & (F.size("points") == 1)).collect()
    assert {bytes(r.id) for r in found} == {ids[k] for k, d in walk(2, 3, None).items() if d >= 1 and cosine(k, vectors[2]) < 0.5 and len(points[k]) == 1}
    node = m.engine.get_node(main, ids[5])
    assert [tuple(p.values()) for p in node["temporal"]] == points[5] and m.engine.get_node(main, bytes(32)) is None
    m.close()


def test_near_cells_of_a_large_commit(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 24))).astype(np.float32)
    path = str(tmp_path / "store")
    m = SessionManager(spark, path)
    s = m.fork_session(m.main_branch()).id
    rows = lambda k, e: pa.table({"key": [b"v%d" % i for i in range(k, e)], "vector": pa.array(x[k:e].tolist(), pa.list_(pa.float32())), "assertion_time": [1] * (e - k), "valid_time": [1] * (e - k)})
    m.ingest(s, rows(0, 5000))
    m.ingest(s, rows(5000, 6000))  # too few for cells of their own
    assert len(m.engine.celled) == 1 and m.engine.near(s, x[0].tolist()).count() < 0.6 * 5000 + 1000
    hits = 0
    for q in range(0, 6000, 600):
        text = f"VECTOR NEAREST [{', '.join(map(repr, x[q].tolist()))}] LIMIT 10"
        exact, fast = (set(m.query(s, text, exact=e).column("id").to_pylist()) for e in (True, False))
        hits += len(exact & fast)
    assert hits >= 95
    want = np.argsort(((x - x[7]) ** 2).sum(1), kind="stable")[:3]
    assert bytes(m.engine.nearest(s, x[7].tolist(), 3, "l2").first().id) == node_id_of(b"v7") and want[0] == 7
    m.close()
    m = SessionManager(spark, path)
    assert len(m.engine.celled) == 1 and m.query(s, text).num_rows == 10 and m.engine.validate() == 2
    m.close()


def test_ordered_scan_and_the_facade(spark, tmp_path):
    m = SessionManager(spark, str(tmp_path / "store"))
    e, main = m.engine, m.main_branch()
    t = e.begin(main)
    for k in (9, 2, 250, 30):
        t.put(bytes([k]), b"v", k, k + 1)
        t.put(bytes([k]), b"w", k + 1, k + 2)
    t.commit()
    assert [(bytes(r.key)[0], r.valid_from) for r in e.scan(main).collect()] == [(2, 2), (2, 3), (9, 9), (9, 10), (30, 30), (30, 31), (250, 250), (250, 251)]
    assert [bytes(r.key)[0] for r in e.scan(main, bytes([9]), bytes([250])).collect()] == [9, 9, 30, 30]
    child = m.fork_session(main).id
    put(e, child, b"z", b"z")
    assert m.merge(main, child).applied_ranges == 1 and m.io_stats()["named"] == 3 and m.io_stats()["bytes"] > 0
    m.close()


def test_sessions_seal_and_outlast_a_restart(spark, tmp_path):
    path = str(tmp_path / "store")
    m = SessionManager(spark, path)
    s = m.fork_session(m.main_branch()).id
    n = 2050
    table = pa.table({"key": [f"doc-{k:08d}".encode() for k in range(n)], "vector": pa.array([[1.0, k / n] for k in range(n)], pa.list_(pa.float32(), 2)), "assertion_time": pa.array(range(n), pa.uint64()), "valid_time": pa.array([100] * n, pa.int64())})
    m.ingest(s, table)
    with pytest.raises(errors.DuplicateNode):
        m.ingest(s, table.slice(0, 1))
    assert [b.num_rows for b in m.query_batches(s, f"VECTOR NEAREST [1.0, 0.0] LIMIT {n}")] == [1024, 1024, 2]
    assert [b.num_rows for b in m.query_batches(m.main_branch(), "VECTOR NEAREST [1.0, 0.0] LIMIT 3")] == [0]
    assert m.engine.node_count(s) == n and m.engine.node_count(m.main_branch()) == 0
    assert m.commit_session(s).status == m.commit_session(s).status == "sealed"
    with pytest.raises(errors.SessionError):
        m.ingest(s, table)
    with pytest.raises(errors.SessionError):
        m.ingest(m.main_branch(), table)
    m.close()
    m = SessionManager(spark, path)
    assert m.session(s).status == "sealed" and m.query(s, "VECTOR NEAREST [1.0, 0.0] LIMIT 1").num_rows == 1
    m.close()


def test_nodes_are_checked(engine):
    main = engine.main_branch().id
    t = engine.begin(main)
    t.put_node(b"a", [], [1.0, 0.0], [])
    with pytest.raises(errors.DuplicateNode):
        t.put_node(b"a", [], [1.0, 0.0], [])
    with pytest.raises(errors.InvalidVector):
        t.put_node(b"b", [], [float("nan")], [])
    t.put_node(b"c", [], [1.0], [])
    with pytest.raises(errors.DimensionMismatch):
        t.commit()


def spec(blocks):
    return KvCacheSpec("5e" * 32, "Fp16", "VllmPagedV1", 2, blocks, 3, 8, 4, 40)


def test_caches(spark, tmp_path):
    store = KvCacheStore(spark, str(tmp_path))
    n = 6000
    data = np.random.default_rng(77).bytes(spec(n).expected_bytes())  # 4.6 MB: two blocks
    assert len(data) == 2 * 2 * n * 3 * 8 * 4 * 2
    store.put("a", spec(n), data)
    assert store.get("a")[0] == data
    ticket = store.restore_ticket("a")
    raw, device = open(ticket["data_path"], "rb").read(), bytearray(sum(e["transfer_length"] for e in ticket["extents"]))
    assert len(ticket["extents"]) == -(-len(data) // CHUNK) == 2
    for e in ticket["extents"]:  # as one who reads by the ticket alone would
        assert e["transfer_length"] % 4096 == e["file_offset"] % 4096 == e["device_offset"] % 4096 == 0
        device[e["device_offset"] : e["device_offset"] + e["transfer_length"]] = raw[e["file_offset"] : e["file_offset"] + e["transfer_length"]]
    assert device[: len(data)] == data
    store.inherit("a", "b")
    small = spec(1).expected_bytes()
    store.put("a", spec(1), bytes(small))
    assert store.get("b")[0] == data and store.get("a")[0] == bytes(small)
    store.inherit("nothing", "c")
    assert store.get("c") is None and store.restore_ticket("c") is None
    for fault in ("data", "before", "torn"):
        with pytest.raises(errors.InjectedFault):
            KvCacheStore(spark, str(tmp_path)).put("a", spec(1), b"q" * small, fault)
    again = KvCacheStore(spark, str(tmp_path))
    assert again.get("a")[0] == bytes(small) and again.validate_all() == 2
    assert again.data_length() == len(data) + small
    with pytest.raises(errors.KvCacheError):
        again.put("a", spec(1), b"short")
    with pytest.raises(errors.KvCacheError):
        KvCacheSpec("x", "Fp16", "VllmPagedV1", 0, 1, 1, 8, 4, 1).expected_bytes()
    assert spec(1).vllm_key_shape() == (1, 3, 1, 4, 8) and spec(1).vllm_value_shape() == (1, 3, 8, 4)
    path = again.restore_ticket("a")["data_path"]
    for at in (5, 4096 + 9):  # of the header, of the payload
        whole = open(path, "rb").read()
        open(path, "wb").write(whole[:at] + b"\x99" + whole[at + 1 :])
        with pytest.raises(errors.KvCacheError):
            again.get("a")
        with pytest.raises(errors.KvCacheError):
            again.validate_all()
        open(path, "wb").write(whole)


def test_stream_of_records(spark, engine, tmp_path):
    source = str(tmp_path / "in")
    spark.range(20).selectExpr("cast(concat('k', id % 3) AS binary) AS key", "cast(id AS string) AS v", "id AS a").select("key", F.col("v").cast("binary").alias("value"), F.col("a").alias("valid_from"), (F.col("a") + 5).alias("valid_to")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    main = engine.main_branch().id
    stream_records(stream, engine, main, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert engine.records(main).count() == 20


def test_quantize():
    assert quantize([3.0, -1.5, 0.0, 6.0]) == ([64, -32, 0, 127], quantize([6.0])[1])
    assert quantize([0.0, 0.0])[0] == [0, 0]


class Tensor:
    """Offers its memory by DLPack and nothing else."""

    def __init__(self, array):
        self.array = array

    def __dlpack__(self, **options):
        return self.array.__dlpack__()

    def __dlpack_device__(self):
        return self.array.__dlpack_device__()


def test_cache_adapters(spark, tmp_path):
    m = SessionManager(spark, str(tmp_path / "store"))
    s = m.fork_session(m.main_branch()).id
    tensor = np.random.default_rng(3).normal(size=(2, 2, 96)).astype(np.float16)
    adapter, n = PagedCacheAdapter(m), spec(1).expected_bytes()
    for cache in (tensor, Tensor(tensor), np.asfortranarray(tensor), bytearray(tensor.tobytes())):
        adapter.store(s, spec(1), cache)
        out = bytearray(n)
        adapter.restore_into(s, out)
        assert out == tensor.tobytes() == bytes(adapter.restore_bytes(s)[0])
    assert "CpuDirect" in adapter.restore_ticket(s)
    child = m.fork_session(s).id
    assert bytes(adapter.restore_bytes(child)[0]) == tensor.tobytes()
    row = m.download_kv_cache(child)
    assert row.column_names == ["bytes", "spec_json"] and row.num_rows == 1
    m.upload_kv_cache(s, row)
    assert m.get_kv_cache(s) == (tensor.tobytes(), spec(1)) and m.download_kv_cache(m.main_branch()) is None
    with pytest.raises(errors.KvCacheError):
        LayerMajorCacheAdapter(m).store(s, spec(1), tensor)
    with pytest.raises(errors.KvCacheError):
        adapter.store(s, spec(1), object())
    with pytest.raises(errors.SessionError):
        m.restore_into(s, bytearray(3))
    m.close()
