from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from latticeframe.errors import InvalidQuery
from latticeframe.plans import CatalogStats, MatchQuery, NearestQuery, explain, optimize, parse, plan_logical

ID = "ab" * 32
MATCH = f"MATCH (a)-[:EDGE*..3]->(b) FROM {ID} VECTOR [1.0, -0.5e1] COSINE > 0.8 ASSERTION < 100 VALID <= -20 EDGE_TYPE = 7 AS OF SYSTEM TIME 98 RETURN id,score LIMIT 10;"


def test_match():
    q = parse(MATCH)
    assert q == MatchQuery(bytes.fromhex(ID), 3, (1.0, -5.0), 0.8, 100, -20, 10, 7, 98)
    assert plan_logical(q).asserted_before == 99


def test_hops_win_and_clauses_are_free_in_order():
    text = f"MATCH LIMIT 4 VALID <= 1 ASSERTION < 2 COSINE > 1 VECTOR [1] HOPS 2 *1..5 FROM {ID}"
    q = parse(text)
    assert (q.max_hops, q.limit, q.edge_type, q.as_of) == (2, 4, None, None)


def test_nearest():
    assert parse("vector nearest [1, 2] limit 0") == NearestQuery((1.0, 2.0), 0)


def test_hop_bounds():
    assert parse(MATCH.replace("*..3", "*5..3")).max_hops == 3  # only the upper bound counts
    for text in (MATCH.replace("*..3", "*0..0"), MATCH.replace("(a)-[:EDGE*..3]->(b)", "HOPS 0")):
        with pytest.raises(InvalidQuery):
            parse(text)


@pytest.mark.parametrize("text", [
    "", "SELECT 1", MATCH.replace("FROM", "FRM"), MATCH.replace(ID, ID[:-1]), MATCH.replace("*..3", "*3.."), MATCH.replace("0.8", "1.1"), MATCH.replace("[1.0, -0.5e1]", "[]"),
    MATCH.replace("[1.0, -0.5e1]", "[nan]"), MATCH.replace("LIMIT 10", "LIMIT 0"), MATCH.replace("LIMIT 10", ""), MATCH.replace("EDGE_TYPE = 7", "EDGE_TYPE = 65536"), "VECTOR NEAREST [1]", "VECTOR NEAREST 1 LIMIT 1",
])
def test_errors(text):
    with pytest.raises(InvalidQuery):
        parse(text)


def plan(cosine, hops, edge, nodes=1_000_000, degree=8.0):
    return optimize(plan_logical(MatchQuery(b"\0" * 32, hops, (1.0,), cosine, 1, 1, 10, edge)), CatalogStats(nodes, degree))


def test_access_paths():
    assert plan(0.99, 3, 7).access == "VectorFirst"
    assert plan(0.8, 3, 7).access == "GraphFirst"
    assert plan(0.8, 9, None).access == "VectorFirst"
    assert plan(0.8, 2, None).access == "GraphFirst"
    assert explain(plan(0.5, 3, None)) == "PhysicalPlan(access=GraphFirst, estimated_cost=512.000, limit=10, projection=[id,score,depth])"
    assert explain(optimize(plan_logical(NearestQuery((1.0,), 3)), CatalogStats(8))) == "PhysicalPlan(access=VectorOnly, estimated_cost=3.000, limit=3, projection=[id,score])"


@given(st.text(max_size=80))
def test_any_text_parses_or_is_invalid(text):
    for t in (text, "MATCH " + text, "VECTOR NEAREST " + text):
        try:
            parse(t)
        except InvalidQuery:
            pass
