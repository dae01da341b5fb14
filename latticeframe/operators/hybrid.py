"""Vector, graph and time in one query, by either access path.

Both paths return rows with ``score >= least``, one temporal point within both bounds, and a depth within the hop
limit, ordered by score (descending), depth and id.  ``points`` is an array of (assertion_time, valid_time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, search


def point_within(points: Column, asserted_before: int, valid_until: int) -> Column:
    """Whether one point meets both bounds; false without points."""
    return F.exists(points, lambda p: (p["assertion_time"] < asserted_before) & (p["valid_time"] <= valid_until))


def effective_bound(asserted_before: int, as_of: int | None) -> int:
    """The assertion bound tightened by AS OF SYSTEM TIME."""
    return asserted_before if as_of is None else min(asserted_before, as_of + 1)


def _ordered(rows: DataFrame, limit: int | None) -> DataFrame:
    out = rows.select("id", "score", "depth").orderBy(F.desc("score"), "depth", "id")
    return out if limit is None else out.limit(limit)


def graph_first(nodes: DataFrame, edges: DataFrame, start: DataFrame, query: list[float], least: float, asserted_before: int, valid_until: int, max_hops: int, edge_type: int | None = None, limit: int | None = None) -> DataFrame:
    """Walk first, then score only what was reached."""
    near = graph.reachable(nodes, edges, start, max_hops, edge_type).select("id", "depth")
    reached = near.join(nodes, "id").where(point_within(F.col("points"), asserted_before, valid_until))
    return _ordered(search.scored(reached, query).where(F.col("score") >= least), limit)


def vector_first(nodes: DataFrame, edges: DataFrame, start: DataFrame, query: list[float], least: float, asserted_before: int, valid_until: int, max_hops: int, edge_type: int | None = None, limit: int | None = None) -> DataFrame:
    """Score and filter all nodes first, then keep those that are reached."""
    good = search.scored(nodes.where(point_within(F.col("points"), asserted_before, valid_until)), query).where(F.col("score") >= least).select("id", "score")
    near = graph.reachable(nodes, edges, start, max_hops, edge_type).select("id", "depth")
    return _ordered(good.join(near, "id"), limit)
