"""Streams of facts into a branch: each micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..storage.branch import Engine


def stream_records(records: DataFrame, engine: Engine, branch_id: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Commits a stream of (key, value, valid_from, valid_to) to a branch, a commit for each non-empty micro-batch.

    A replayed batch asserts the same ranges again at a later epoch, which leaves the latest values as they are.
    """
    def write(batch: DataFrame, _: int) -> None:  # noqa: E306
        if not batch.isEmpty():
            t = engine.begin(branch_id)
            t.put_records(batch)
            t.commit()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
