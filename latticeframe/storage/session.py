"""Sessions over an engine: fork, ingest, query, seal; the facade a client uses."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import SessionError
from ..plans import explain, optimize, parse, plan_logical
from ..sources.arrow import node_rows, result_batches
from .branch import Engine
from .kvcache import KvCacheSpec, KvCacheStore


@dataclass(frozen=True)
class Session:
    id: str
    parent: str
    status: str


class SessionManager:
    """A session is a branch that takes writes until it is sealed; its status lives in the log, so it outlasts a restart."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.engine = spark, Engine(spark, directory)
        self.caches = KvCacheStore(spark, directory)

    def close(self) -> None:
        self.engine.close()

    def main_branch(self) -> str:
        return self.engine.main_branch().id

    def session(self, session_id: str) -> Session | None:
        b = self.engine._branches.get(session_id)
        return Session(b.id, b.parent, b.status) if b and b.status in ("active", "sealed") else None

    def fork_session(self, parent: str) -> Session:
        b = self.engine.fork(parent, "active")
        self.caches.inherit(parent, b.id)
        return self.session(b.id)

    def commit_session(self, session_id: str) -> Session:
        """Seals the session; sealing twice is the same as once.  It doesn't merge."""
        s = self.session(session_id)
        if s is None:
            raise SessionError(f"unknown session {session_id}")
        if s.status != "sealed":
            self.engine.set_status(session_id, "sealed")
        return self.session(session_id)

    def _writable(self, session_id: str) -> None:
        s = self.session(session_id)
        if s is None or s.status != "active":
            raise SessionError(f"{session_id} takes no writes")

    def ingest(self, session_id: str, rows) -> None:
        """Nodes from an Arrow table or a DataFrame (key, vector, assertion_time, valid_time), in one commit; nodes without edges."""
        self._writable(session_id)
        t = self.engine.begin(session_id)
        t.put_nodes(node_rows(self.spark, rows))
        t.commit()

    def ingest_nodes(self, session_id: str, nodes: DataFrame) -> None:
        """Whole nodes in the shape of ``schemas.NODE_INPUT``."""
        self._writable(session_id)
        t = self.engine.begin(session_id)
        t.put_nodes(nodes)
        t.commit()

    def _plan(self, branch: str, text: str):
        return optimize(plan_logical(parse(text)), self.engine.catalog(branch))

    def explain(self, branch: str, text: str) -> str:
        return explain(self._plan(branch, text))

    def query_frame(self, branch: str, text: str, exact: bool = False) -> DataFrame:
        """The rows of a query; ``exact`` makes VECTOR NEAREST read all nodes rather than the near cells."""
        return self.engine.execute(branch, self._plan(branch, text), exact)

    def query(self, branch: str, text: str, exact: bool = False) -> pa.Table:
        return pa.Table.from_batches(self.query_batches(branch, text, exact=exact))

    def query_batches(self, branch: str, text: str, rows: int = 1024, exact: bool = False) -> list[pa.RecordBatch]:
        """Batches of at most ``rows`` rows; an empty result is one empty batch."""
        return result_batches(self.query_frame(branch, text, exact).toArrow(), rows)

    def merge(self, target: str, source: str):
        """Merges a branch's changed ranges into another; see ``Engine.merge``."""
        return self.engine.merge(target, source)

    def io_stats(self) -> dict:
        return self.engine.storage_stats()

    def download_kv_cache(self, branch: str) -> pa.Table | None:
        """A cache as a table of one row: bytes, spec_json."""
        found = self.get_kv_cache(branch)
        return found and pa.table({"bytes": pa.array([found[0]], pa.large_binary()), "spec_json": [found[1].to_json()]})

    def upload_kv_cache(self, branch: str, table: pa.Table) -> dict:
        if table.num_rows != 1 or not {"bytes", "spec_json"} <= set(table.column_names):
            raise SessionError("a cache is one row of bytes and spec_json")
        return self.put_kv_cache(branch, table.column("spec_json")[0].as_py(), table.column("bytes")[0].as_buffer())

    def query_pandas(self, branch: str, text: str):
        return self.query(branch, text).to_pandas()

    def query_polars(self, branch: str, text: str):
        """A lazy polars frame, where polars is installed."""
        import polars

        return polars.from_arrow(self.query(branch, text)).lazy()

    def export_fused(self, branch: str) -> DataFrame:
        return self.engine.projections(branch)

    def put_kv_cache(self, branch: str, spec: KvCacheSpec | dict | str, data) -> dict:
        self._writable(branch)
        if not isinstance(spec, KvCacheSpec):
            spec = KvCacheSpec.from_json(spec if isinstance(spec, str) else json.dumps(spec))
        return self.caches.put(branch, spec, data)

    def get_kv_cache(self, branch: str) -> tuple[bytes, KvCacheSpec] | None:
        self.engine.branch(branch)
        return self.caches.get(branch)

    def restore_into(self, branch: str, destination) -> KvCacheSpec:
        found = self.get_kv_cache(branch)
        target = memoryview(destination).cast("B")
        if found is None or len(target) != len(found[0]):
            raise SessionError("the destination's size isn't the cache's")
        target[:] = found[0]
        return found[1]

    def get_kv_cache_manifest(self, branch: str) -> str:
        return json.dumps(self.caches.manifest(branch))

    def get_kv_cache_ticket(self, branch: str) -> str:
        return json.dumps(self.caches.restore_ticket(branch))

    def hardware_capabilities(self) -> str:
        return json.dumps({"transfer_path": "CpuDirect", "gpu_direct": False})

    def validate(self) -> int:
        return self.engine.validate() + self.caches.validate_all()

