"""The physical plans that matter at scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeframe import catalogue
from latticeframe.operators import graph, search, temporal

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_needs_no_shuffle_of_rows(spark):
    text = plan(search.nearest(catalogue.nodes_q(spark, SF), [0.1] * 64, 5))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text and "Python" not in text


def test_as_of_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "records")
    catalogue.records(spark, SF).write.parquet(path)
    text = plan(temporal.get_as_of(spark.read.parquet(path), "click:3", 1704844800000000, 500))
    assert "PushedFilters: [IsNotNull(key)" in text and "EqualTo(key," in text
    assert "Exchange" not in text


def test_as_of_join_aggregates_before_its_shuffle(spark):
    text = plan(catalogue.as_of_join(spark, SF))
    assert "Window" not in text and "partial_min_by" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_point_lookup_reads_two_columns(spark):
    text = plan(catalogue.point_lookup(spark, SF))
    assert "ReadSchema: struct<vec_id:bigint,label:" in text and "EqualTo(vec_id,42)" in text


def test_threshold_scan_is_one_stage(spark):
    text = plan(search.threshold_scan(catalogue.nodes_q(spark, SF).where(F.col("label") == 1), [0.1] * 64, 0.5))
    assert "Exchange" not in text and "EqualTo(label,1)" in text


def test_walks_shuffle_neither_edges_nor_nodes(spark, tmp_path):
    spark.range(2000).selectExpr("id AS src", "(id * 7 + 1) % 2000 AS dst", "1 AS edge_type").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    frontier = spark.createDataFrame([(0, 0), (0, 5)], "start long, id long")
    text = plan(graph._hops(frontier, edges.select("src", "dst")))
    below = text[text.index("BroadcastHashJoin") :]
    assert below.count("Exchange") == below.count("BroadcastExchange") == 1 and "Scan" in below and "SortMergeJoin" not in text
