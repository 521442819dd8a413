"""Aggregates on odd rows, and where their plans shuffle."""

from __future__ import annotations

import datetime as dt

from quillmesh.operators import aggregates as op

DAY = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_zones_count_commits_in_all_partitions(spark):
    rows = [(f"a/b{z}/f{i}.py", i % 12) for z in range(3) for i in range(24)] + [("a/b0/g.py", None), (None, 1), ("a/b1/g.py", 99), ("c/d/e.py", 1)]
    orders = spark.createDataFrame([(i,) for i in [*range(12), 99, None]], "commit_id int").hint("merge")
    got = op.hot_zones(spark.createDataFrame(rows, "path string, commit_id int").join(orders, "commit_id"))
    assert [tuple(r) for r in got.collect()] == [("a/b1", 13), ("a/b0", 12), ("a/b2", 12)]
    assert "REPARTITION_BY_NUM" in plan(got)  # not in the few partitions that the join's small rows are put in


def test_churn_shuffles_a_row_once(spark):
    rows = [("p", 1, "x", DAY[1], 3, 1), ("p", 1, "y", DAY[2], 4, 1), ("p", 2, "x", DAY[3], None, 1), ("p", None, None, DAY[4], 5, None), ("p", 1, "x", DAY[1], 3, 1),
        (None, 1, "x", DAY[5], 1, 1), (None, 2, "x", DAY[6], 1, 1), ("p", 9, "z", DAY[0], 1, 1), ("q", None, None, DAY[7], None, None), ("p", 7, "w", None, 1, 1)]
    got = op.churn(spark.createDataFrame(rows, "path string, commit_id long, author string, ts timestamp_ntz, added long, removed long"), "2024-01-02")
    want = {("p", 2, 15, 4, DAY[1], DAY[4], 2), (None, 2, 2, 2, DAY[5], DAY[6], 1), ("q", 0, None, None, DAY[7], DAY[7], 0)}
    assert {tuple(r) for r in got.select("path", "commits", "added", "removed", "first_seen", "last_seen", "authors").collect()} == want
    assert plan(got).count("Exchange") == 1 and "Expand" not in plan(got)


def test_node_scores_make_edges_once(spark):
    nodes = spark.createDataFrame([("file:a", 0.0, False, 0), ("file:b", 0.0, False, 0), ("file:c", 0.0, False, 0)], "id string, confidence double, validated boolean, refs int")
    edges = [("file:a", "file:b"), ("file:a", "file:b"), ("file:b", "file:a"), ("sym:s", "file:a"), ("file:c", "ext:n"), ("file:a", "file:a"), ("file:a", "file:c")]
    enriched = spark.createDataFrame([("file:b", 2)], "id string, depth int")
    got = op.node_scores(nodes, spark.createDataFrame(edges, "source string, target string"), enriched)
    # a: one of a, b, c is enriched; b and c: not a
    assert {r.id: r.composite for r in got.collect()} == {"file:a": round(0.2353 / 3, 3), "file:b": round(0.1765 + 0.1764 / 2, 3), "file:c": 0.0}
    assert "Union" not in plan(got)
