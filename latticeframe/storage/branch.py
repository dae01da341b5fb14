"""Branches of bitemporal records and of nodes, as sets of immutable Parquet files named by a commit log.

A branch is two lists of files (records, nodes); a fork copies the lists, a commit adds a file to each and then
one log record, so a commit is visible as a whole or not at all, and files that no commit names are ignored.  A record names
only what is new; every ``CHECKPOINT`` commits the whole state is written beside the log.

A commit of many nodes groups them in cells around centres of its own, as many as its rows ask for, and writes them
sorted by cell: a nearest search reads only the cells near its vector of each such file, and all rows of small ones.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import CorruptData, DimensionMismatch, DuplicateNode, InjectedFault, InvalidInterval, InvalidVector, Invariant, MergeConflict, StaleTransaction, UnknownBranch
from ..functions import scalar as S
from ..functions import vector as V
from ..operators import graph, hybrid, search, temporal
from ..plans import CatalogStats, NearestQuery, PhysicalPlan, run
from ..sources.files import file_store
from .log import CHECKPOINT, CommitLog

FAULTS = ("data", "before", "torn")
CELLED = 4096  # nodes of a commit from which on it has cells
LISTS = ("records", "nodes", "fork_records")


@dataclass(frozen=True)
class Branch:
    id: str
    parent: str | None
    epoch: int
    records: tuple = ()
    nodes: tuple = ()
    fork_records: tuple = ()
    dimension: int | None = None
    status: str = "main"


@dataclass(frozen=True)
class MergeOutcome:
    branch: Branch
    applied_ranges: int


def _flat(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("vector").alias("codes"), F.col("quantization_scale").alias("scale"), F.col("square_norm").alias("nn"), F.col("temporal").alias("points"))


class Engine:
    """A store in one directory; one engine holds it at a time."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")
        self.log = CommitLog(spark, self.directory)
        self.log.lock()
        self.epoch, self._branches, self.digests, self.celled, self._centres = 0, {}, {}, set(), {}
        try:
            state, payloads = self.log.replay()
            if state:
                self._load(state)
            for payload in payloads:
                self._apply(payload)
            if not self._branches:
                self._commit({"kind": "create", "branch": Branch(uuid.uuid4().hex, None, 0).__dict__})
        except BaseException:
            self.log.unlock()
            raise

    @classmethod
    def open(cls, spark: SparkSession, directory: str) -> Engine:
        return cls(spark, directory)

    def close(self) -> None:
        self.log.unlock()

    # the log ------------------------------------------------------------------------------------------------------

    def _load(self, state: dict) -> None:
        self.epoch, self.digests, self.celled = state["epoch"], state["digests"], set(state["celled"])
        for b in state["branches"]:
            self._branches[b["id"]] = Branch(**{k: tuple(v) if k in LISTS else v for k, v in b.items()})

    def _state(self) -> dict:
        return {"epoch": self.epoch, "digests": self.digests, "celled": sorted(self.celled), "branches": [b.__dict__ for b in self._branches.values()]}

    def _apply(self, payload: dict) -> None:
        """A record names a branch's new fields; its lists are the former ones, or the parent's for a fork, and what is added."""
        fields = dict(payload["branch"])
        if fields["epoch"] < self.epoch:
            raise Invariant("epochs run backwards")
        old = self._branches.get(fields["id"])
        if old is None and fields["parent"] is not None:
            parent = self._branches[fields["parent"]]
            old = Branch(fields["id"], fields["parent"], fields["epoch"], parent.records, parent.nodes, parent.records)
        for name in LISTS:
            fields[name] = (getattr(old, name) if old else ()) + tuple(payload.get("add", {}).get(name, ()))
        self.epoch = fields["epoch"]
        self._branches[fields["id"]] = Branch(**fields)
        self.digests.update(payload.get("digests", {}))
        self.celled.update(payload.get("celled", ()))

    def _commit(self, payload: dict, fault: str | None = None) -> None:
        self.log.append(payload, fault)
        self._apply(payload)
        if self.log.version % CHECKPOINT == 0:
            self.log.checkpoint(self._state())

    def _put(self, branch: Branch, kind: str, digests: dict | None = None, fault: str | None = None, celled: list | None = None) -> Branch:
        old = self._branches.get(branch.id) or (self._branches.get(branch.parent) if branch.parent else None)
        add = {n: list(getattr(branch, n)[len(getattr(old, n)) :]) for n in ("records", "nodes")} if old else {}
        fields = {k: v for k, v in branch.__dict__.items() if k not in LISTS}
        self._commit({"kind": kind, "branch": fields, "add": {n: x for n, x in add.items() if x}, "digests": digests or {}, "celled": celled or []}, fault)
        return self._branches[branch.id]

    # branches -----------------------------------------------------------------------------------------------------

    def main_branch(self) -> Branch:
        roots = [b for b in self._branches.values() if b.parent is None]
        if len(roots) != 1:
            raise Invariant("there is one branch without a parent")
        return roots[0]

    def branch(self, branch_id: str) -> Branch:
        if branch_id not in self._branches:
            raise UnknownBranch(branch_id)
        return self._branches[branch_id]

    def branches(self) -> list[Branch]:
        return list(self._branches.values())

    def fork(self, parent_id: str, status: str = "branch") -> Branch:
        """A new branch with the parent's files: one log record, whatever the parent's size."""
        p = self.branch(parent_id)
        return self._put(Branch(uuid.uuid4().hex, p.id, self.epoch + 1, p.records, p.nodes, p.records, p.dimension, status), "fork")

    def set_status(self, branch_id: str, status: str) -> Branch:
        b = self.branch(branch_id)
        return self._put(Branch(**{**b.__dict__, "status": status, "epoch": self.epoch}), "status")

    def begin(self, branch_id: str) -> Transaction:
        return Transaction(self, self.branch(branch_id))

    # reads --------------------------------------------------------------------------------------------------------

    def _files(self, names: tuple, schema) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.directory}/{n}" for n in names))

    def records(self, branch_id: str) -> DataFrame:
        return self._files(self.branch(branch_id).records, schemas.RECORD)

    def scan(self, branch_id: str, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All records, or those with ``low`` <= key < ``high``, in order of key, range and assertion: a range-partitioned sort."""
        rows = self.records(branch_id)
        if low is not None:
            rows = rows.where(F.col("key") >= F.lit(bytearray(low)))
        if high is not None:
            rows = rows.where(F.col("key") < F.lit(bytearray(high)))
        return rows.orderBy("key", "valid_from", "valid_to", "asserted_at")

    def get_node(self, branch_id: str, node_id: bytes) -> dict | None:
        """A node by its id; the filter reaches the files' statistics."""
        found = self.nodes(branch_id).where(F.col("id") == F.lit(bytearray(node_id))).limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    def storage_stats(self) -> dict:
        """Files that branches name, and bytes and files below the store's folder."""
        path = self.log._jvm.org.apache.hadoop.fs.Path(self.directory)
        size = path.getFileSystem(self.log._conf).getContentSummary(path)
        names = {n for b in self._branches.values() for n in (*b.records, *b.nodes)}
        return {"named": len(names), "files": size.getFileCount(), "bytes": size.getLength(), "commits": self.log.version}

    def nodes(self, branch_id: str) -> DataFrame:
        """The branch's nodes, nested: id, temporal, vector (codes), quantization_scale, square_norm, edges."""
        return self._files(self.branch(branch_id).nodes, schemas.NODE)

    def projections(self, branch_id: str) -> DataFrame:
        return self.nodes(branch_id).select("id", "temporal", "vector", "quantization_scale", "edges")

    def node_count(self, branch_id: str) -> int:
        return self.nodes(branch_id).count()

    def get(self, branch_id: str, key: bytes, at: int) -> dict | None:
        return self.get_as_of(branch_id, key, at, None)

    def get_as_of(self, branch_id: str, key: bytes, at: int, known_by: int | None) -> dict | None:
        found = temporal.get_as_of(self.records(branch_id), F.lit(bytearray(key)), at, known_by).collect()
        return found[0].asDict() if found else None

    def index(self, branch_id: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as the operators take them."""
        n = self.nodes(branch_id)
        return _flat(n), graph.exploded_edges(n)

    def _centres_of(self, name: str) -> np.ndarray:
        if name not in self._centres:
            store, root = file_store(self.directory)
            with store.open_input_stream(f"{root}/{name.replace('nodes/', 'centres/', 1)}.npy") as f:
                self._centres[name] = np.load(io.BytesIO(f.read()))
        return self._centres[name]

    def near(self, branch_id: str, vector: list[float], probes: int | None = None) -> DataFrame:
        """Nodes in the cells near a vector, as the operators take them: the candidates of an approximate search."""
        parts = []
        plain = tuple(n for n in self.branch(branch_id).nodes if n not in self.celled)
        if plain:
            parts.append(_flat(self._files(plain, schemas.NODE)))
        for name in self.branch(branch_id).nodes:
            if name in self.celled:
                centres = self._centres_of(name)
                cells = search.nearest_cells(centres, V.quantize(vector)[0], probes or search.probes_for(len(centres)))
                parts.append(_flat(self._files((name,), schemas.CELLED_NODE).where(F.col("cell").isin(cells))))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def stats(self, branch_id: str) -> dict:
        size = S.node_bytes(F.size("vector"), F.size("temporal"), F.size("edges"))
        row = self.nodes(branch_id).agg(F.count("*").alias("nodes"), F.coalesce(F.sum(size), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum(F.size("edges")), F.lit(0)).alias("edges")).first()
        return row.asDict() | {"files": len(self.branch(branch_id).nodes)}

    def nearest(self, branch_id: str, vector: list[float], k: int, metric: str = "cosine", exact: bool = False, probes: int | None = None) -> DataFrame:
        """The k nodes nearest by cosine or (always exactly) ``l2``: among the near cells, or among all on request."""
        b = self.branch(branch_id)
        if k == 0 or not b.nodes:
            return self.spark.createDataFrame([], "id binary, score double")
        search.check_query(vector, b.dimension)
        rows = self.index(branch_id)[0] if exact or metric != "cosine" else self.near(branch_id, vector, probes)
        return search.nearest(rows, vector, k, metric)

    def execute(self, branch_id: str, plan: PhysicalPlan, exact: bool = False) -> DataFrame:
        """id, score (float), depth of a plan's rows; an index-less branch has none."""
        b, q = self.branch(branch_id), plan.logical.query
        if not b.nodes or q.limit == 0:
            return self.spark.createDataFrame([], schemas.QUERY_ROW)
        search.check_query(list(q.vector), b.dimension)
        nodes, edges = self.index(branch_id)
        if isinstance(q, NearestQuery) and not exact:
            nodes = self.near(branch_id, list(q.vector))
        rows = run(plan, nodes, edges)
        return rows.select("id", F.col("score").cast("float").alias("score"), F.col("depth").cast("int").alias("depth"))

    def traverse(self, branch_id: str, start: bytes, vector: list[float], max_hops: int, edge_type: int | None = None, keep=None) -> DataFrame:
        """id, score, depth of the reached nodes that ``keep``, a condition over node columns, depth and score, accepts."""
        search.check_query(vector, self.branch(branch_id).dimension)
        nodes, edges = self.index(branch_id)
        starts = self.spark.createDataFrame([(bytearray(start),)], "id binary")
        return hybrid._ordered(graph.traverse(nodes, edges, starts, max_hops, edge_type, keep, vector), None)

    def hybrid(self, branch_id: str, start: bytes, vector: list[float], least: float, asserted_before: int, valid_until: int, max_hops: int, edge_type: int | None = None, limit: int | None = None, path: str = "GraphFirst") -> DataFrame:
        """The vector, graph and time query of a branch by the given access path: GraphFirst or VectorFirst."""
        search.check_query(vector, self.branch(branch_id).dimension)
        way = {"GraphFirst": hybrid.graph_first, "VectorFirst": hybrid.vector_first}[path]
        starts = self.spark.createDataFrame([(bytearray(start),)], "id binary")
        return way(*self.index(branch_id), starts, vector, least, asserted_before, valid_until, max_hops, edge_type, limit)

    def catalog(self, branch_id: str, measured: bool = False) -> CatalogStats:
        """Node count, and the measured mean degree where asked for (else the default 3)."""
        s = self.stats(branch_id)
        return CatalogStats(max(1, s["nodes"]), s["edges"] / s["nodes"] if measured and s["nodes"] else 3.0)

    # merge --------------------------------------------------------------------------------------------------------

    def _merge_base(self, target: Branch, source: Branch) -> tuple:
        """The records where two branches parted: of a fork and its origin, or of two forks made at one point."""
        points = {b.id: (b.parent, b.fork_records) for b in (target, source)}
        for one, other in ((target, source), (source, target)):
            if other.id == one.parent or points[one.id] == points[other.id] != (None, ()):
                return one.fork_records
        raise Invariant("a merge joins parent and child, or siblings forked at one point")

    def merge(self, target_id: str, source_id: str) -> MergeOutcome:
        """Applies the source's changed ranges to the target; overlapping differing changes are a conflict.

        The merge base stays where the branches forked, so merging again applies the same changes again.
        """
        target, source = self.branch(target_id), self.branch(source_id)
        if target.nodes != source.nodes:
            raise Invariant("branches with different nodes can't be merged")
        base = temporal.logical_ranges(self._files(self._merge_base(target, source), schemas.RECORD))
        ours, theirs = (temporal.changes(temporal.logical_ranges(self.records(b)), base) for b in (target_id, source_id))
        n = temporal.conflicts(theirs, ours).count()
        if n:
            raise MergeConflict(n)
        epoch = self.epoch + 1
        name, rows, digest = self._write("records", theirs.select("key", "value", "valid_from", "valid_to", F.lit(epoch).cast("long").alias("asserted_at")))
        files = target.records + ((name,) if rows else ())
        merged = Branch(**{**target.__dict__, "records": files, "epoch": epoch})
        return MergeOutcome(self._put(merged, "merge", {name: digest} if rows else {}), rows)

    # files --------------------------------------------------------------------------------------------------------

    def _write_nodes(self, df: DataFrame, rows: int) -> tuple[str, int, list, bool]:
        """A file of nodes; a large one in cells, sorted by them, with their centres beside it."""
        if rows < CELLED:
            return *self._write("nodes", df), False
        sample = df.orderBy(F.xxhash64("id"), "id").limit(20_000).select("vector").collect()
        centres = search.fit_centres(np.array([list(r["vector"]) for r in sample], np.float32), search.cells_for(rows))
        placed = search.with_cells(df.withColumn("v", F.transform("vector", lambda x: x.cast("float"))), centres, "v").drop("v")
        name = f"nodes/{uuid.uuid4().hex}"
        store, root = file_store(self.directory)
        data = io.BytesIO()
        np.save(data, centres)
        store.create_dir(f"{root}/centres", recursive=True)
        with store.open_output_stream(f"{root}/{name.replace('nodes/', 'centres/', 1)}.npy") as f:
            f.write(data.getvalue())
        digest = self._write("nodes", placed.repartitionByRange(max(1, min(rows // CELLED, 4096)), "cell").sortWithinPartitions("cell", "id"), name)[2]
        return name, digest[0], digest, True

    def _write(self, kind: str, df: DataFrame, name: str | None = None) -> tuple[str, int, list]:
        name = name or f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.directory}/{name}")
        digest = self._digest(name, schemas.RECORD if kind == "records" else schemas.NODE)
        return name, digest[0], digest

    def _digest(self, name: str, schema) -> list:
        """Row count and an order-free digest of a file's rows."""
        df = self._files((name,), schema)
        row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
        return [row[0], str(row[1])]

    def validate(self) -> int:
        """Reads every file that a branch names and holds it against its digest; returns how many."""
        names = {n for b in self._branches.values() for n in (*b.records, *b.nodes)}
        for n in sorted(names):
            try:
                found = self._digest(n, schemas.RECORD if n.startswith("records") else schemas.NODE)
            except Exception as e:
                raise CorruptData(n) from e
            if found != self.digests.get(n):
                raise CorruptData(n)
        return len(names)


@dataclass
class Transaction:
    """Staged writes against a branch as it was at ``begin``."""

    engine: Engine
    start: Branch
    records: dict = field(default_factory=dict)
    frames: list = field(default_factory=list)
    nodes: dict = field(default_factory=dict)
    node_frames: list = field(default_factory=list)

    def put(self, key: bytes, value: bytes, valid_from: int, valid_to: int) -> None:
        """A later put of the same key and range replaces an earlier one; the assertion epoch is set at commit."""
        if not valid_from < valid_to:
            raise InvalidInterval(f"[{valid_from}, {valid_to})")
        self.records[bytes(key), valid_from, valid_to] = bytes(value)

    def put_records(self, df: DataFrame) -> None:
        """Many records: key, value, valid_from, valid_to."""
        if not df.where("valid_from >= valid_to OR valid_from IS NULL OR valid_to IS NULL").isEmpty():
            raise InvalidInterval("an interval is empty")
        self.frames.append(df.select("key", "value", "valid_from", "valid_to"))

    def put_node(self, key: bytes, points: list, vector: list[float], edges: list) -> bytes:
        """points: (assertion_time, valid_time); edges: (target id, weight, type).  Returns the node's id."""
        search.check_query(vector, None)
        i = S.node_id_of(bytes(key))
        if i in self.nodes:
            raise DuplicateNode(i.hex())
        if any(not 0 <= a < 1 << 63 for a, _ in points):
            raise InvalidVector("assertion times are from 0 to 2**63 - 1")
        self.nodes[i] = (bytearray(key), [float(x) for x in vector], list(points), [(bytearray(t), float(w), int(k)) for t, w, k in edges])
        return i

    def put_nodes(self, df: DataFrame) -> None:
        """Many nodes in the shape of ``schemas.NODE_INPUT``."""
        self.node_frames.append(df.select(*schemas.NODE_INPUT.fieldNames()))

    def _staged_records(self, epoch: int) -> DataFrame | None:
        spark = self.engine.spark
        frames = [d.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "valid_from", "valid_to") for d in self.frames]
        if self.records:
            frames.append(spark.createDataFrame([(bytearray(k), bytearray(v), a, b) for (k, a, b), v in self.records.items()], "key binary, value binary, valid_from long, valid_to long"))
        if not frames:
            return None
        out = frames[0]
        for d in frames[1:]:
            out = out.unionByName(d)
        return out.withColumn("asserted_at", F.lit(epoch).cast("long"))

    def _staged_nodes(self) -> DataFrame | None:
        spark = self.engine.spark
        frames = list(self.node_frames)
        if self.nodes:
            frames.append(spark.createDataFrame([(k, v, p, e) for k, v, p, e in self.nodes.values()], schemas.NODE_INPUT))
        if not frames:
            return None
        out = frames[0]
        for d in frames[1:]:
            out = out.unionByName(d)
        coded = out.withColumn("id", S.node_id(F.col("key"))).withColumn("scale", V.scale_of(F.col("vector")))
        coded = coded.withColumn("codes", V.codes_of(F.col("vector"), F.col("scale")))
        return coded.select("id", "temporal", F.col("codes").alias("vector"), F.col("scale").alias("quantization_scale"), V.square_norm(F.col("codes")).alias("square_norm"), "edges", F.size(F.filter(F.col("vector"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"))

    def _check_nodes(self, staged: DataFrame) -> tuple[int, int]:
        """Finite vectors of one length, and ids that are new: one aggregation and one semi-join.  Returns the length and the rows."""
        row = staged.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.sum("bad").alias("bad"), F.count("*").alias("n")).first()
        if not row["n"]:
            return self.start.dimension or 0, 0
        if row["bad"] or not 1 <= row["low"] <= row["high"] <= 65535:
            raise InvalidVector("vectors have 1 to 65535 finite components")
        if row["low"] != row["high"] or self.start.dimension not in (None, row["low"]):
            raise DimensionMismatch(f"{row['low']} to {row['high']} components against {self.start.dimension}")
        if not staged.groupBy("id").count().where("count > 1").isEmpty() or not staged.join(self.engine.nodes(self.start.id).select("id"), "id", "left_semi").isEmpty():
            raise DuplicateNode("a node id is already there")
        return row["low"], row["n"]

    def commit(self, fault: str | None = None) -> Branch:
        """Data files first, then one log record; ``fault`` stops after the data, before or within the record."""
        engine, now = self.engine, self.engine.branch(self.start.id)
        if (now.records, now.nodes) != (self.start.records, self.start.nodes):
            raise StaleTransaction(self.start.id)
        epoch, digests = engine.epoch + 1, {}
        records, nodes, dimension, celled = now.records, now.nodes, now.dimension, []
        staged = self._staged_records(epoch)
        if staged is not None:
            name, rows, digest = engine._write("records", staged)
            if rows:
                records, digests[name] = (*records, name), digest
        staged = self._staged_nodes()
        if staged is not None:
            dimension, n = self._check_nodes(staged)
            dimension = dimension or None
            name, rows, digest, in_cells = engine._write_nodes(staged.drop("bad"), n)
            if rows:
                nodes, digests[name] = (*nodes, name), digest
                celled = [name] if in_cells else []
        if fault == "data":
            raise InjectedFault("after the data files")
        return engine._put(Branch(**{**now.__dict__, "records": records, "nodes": nodes, "epoch": epoch, "dimension": dimension}), "commit", digests, fault, celled)
