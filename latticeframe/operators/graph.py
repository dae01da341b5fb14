"""Bounded traversal over ``edges`` (src, dst, edge_type): breadth-first rounds that begin at the frontier.

Each round joins the frontier with the raw edges, then makes distinct and holds against the nodes only what was reached.
A frontier of up to ``LOCAL`` rows is a local table: the planner broadcasts it, so neither edges nor nodes are shuffled
or written, and the scan drops edges from elsewhere.  A larger one is written to the shared folder each round and
joined as the planner's size check says.  Many starts travel in one traversal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownNode
from ..tables import stored

LOCAL = 10_000


def live_edges(edges: DataFrame, nodes: DataFrame, edge_type: int | None = None) -> DataFrame:
    """Distinct (src, dst) of one type or all, without edges whose target isn't a node."""
    some = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    return some.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def _hops(frontier: DataFrame, links: DataFrame) -> DataFrame:
    return frontier.join(links, frontier["id"] == links["src"]).select("start", F.col("dst").alias("id")).distinct()


def reachable(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_hops: int, edge_type: int | None = None) -> DataFrame:
    """start, id, depth: every node within ``max_hops`` of each start (a column ``id``), with its least depth; the start is depth 0."""
    spark, ids = nodes.sparkSession, nodes.select("id")
    kind = nodes.schema["id"].dataType.simpleString()
    local = lambda rows: spark.createDataFrame(rows, f"start {kind}, id {kind}")
    links = (edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)).select("src", "dst")
    known = starts.select(F.col("id").alias("start"), "id").distinct()
    rows = [tuple(r) for r in known.limit(LOCAL + 1).collect()]
    if len(rows) <= LOCAL:
        known = local(rows)
    missing = len(rows) - ids.join(known, "id").distinct().count() if len(rows) <= LOCAL else known.join(ids, "id", "left_anti").count()
    if missing:
        raise UnknownNode("a start is not in the index")
    levels, hop = [(known, 0)], 1
    if len(rows) <= LOCAL:
        frontier, seen = rows, set(rows)
        while hop <= max_hops and frontier:
            step = [tuple(r) for r in _hops(local(frontier), links).limit(LOCAL + 1).collect()]
            if len(step) > LOCAL:
                break
            fresh = [r for r in step if r not in seen]
            seen.update(fresh)
            frontier = [tuple(r) for r in ids.join(local(fresh), "id").select("start", "id").distinct().collect()] if fresh else []
            if frontier:
                levels.append((local(frontier), hop))
            hop += 1
        if not frontier:
            hop = max_hops + 1
    out = None
    for df, depth in levels:
        some = df.withColumn("depth", F.lit(depth))
        out = some if out is None else out.unionAll(some)
    frontier = levels[-1][0]
    for depth in range(hop, max_hops + 1):
        step = stored(_hops(frontier, links), "step")  # its size is known to the planner from here on
        fresh = ids.join(step, "id").select("start", "id").distinct().join(out.select("start", "id"), ["start", "id"], "left_anti")
        frontier = stored(fresh, "frontier")
        if frontier.isEmpty():
            break
        out = out.unionAll(frontier.withColumn("depth", F.lit(depth)))
    return out


def traverse(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_hops: int, edge_type: int | None = None, keep: Column | None = None, query: list[float] | None = None) -> DataFrame:
    """Reachable nodes with their node columns, ``depth`` and, for a ``query`` vector, their ``score``.

    ``keep``, a condition over any of these, filters what is returned, not what is walked through.
    """
    from .search import scored

    found = reachable(nodes, edges, starts, max_hops, edge_type).join(nodes, "id")
    found = found if query is None else scored(found, query)
    return found if keep is None else found.where(keep)


def exploded_edges(nodes: DataFrame) -> DataFrame:
    """src, dst, weight, edge_type from nested ``edges`` arrays."""
    e = nodes.select(F.col("id").alias("src"), F.explode("edges").alias("e"))
    return e.select("src", F.col("e.target").alias("dst"), F.col("e.weight").alias("weight"), F.col("e.edge_type").alias("edge_type"))
