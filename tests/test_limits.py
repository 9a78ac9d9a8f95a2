"""Large vertex ids, large cliques and walks, names of queries."""

import pytest

from graphloom.operators import invariants as inv
from graphloom.operators import structure as st
from graphloom.operators import tables as tb
from graphloom.operators import topology as tp
from graphloom.plans.queries import query


def frame(spark, graphs):
    return spark.createDataFrame([(g, u, v) for g, edges in graphs.items() for u, v in edges], "graph_id long, u int, v int")


def path(n):
    return [(i, i + 1) for i in range(n - 1)]


def clique(n):
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_distances_of_long_paths(spark):
    sizes = (31, 32, 33, 62, 63)
    found = {r["graph_id"]: (r["diameter"], r["wiener"], r["components"]) for r in inv.distance_summary(frame(spark, {n: path(n) for n in sizes})).collect()}
    assert found == {n: (n - 1, n * (n * n - 1) // 6, 1) for n in sizes}
    for operator in (inv.distance_summary, st.neighbour_masks, tb.largest_clique, st.simple_cycles, tp.connectivity):
        with pytest.raises(Exception, match="0 to 62"):
            operator(frame(spark, {1: path(66)})).collect()


def test_wide_row_of_62(spark):
    graphs = spark.createDataFrame([(1,), (2,)], "graph_id long")
    edges = {1: [(100 * u, 100 * v) for u, v in path(62)], 2: clique(5)}
    rows = {r["graph_id"]: r for r in tb.graph_features(graphs, {"x": frame(spark, edges)}, ["distance", "cycles"]).collect()}
    assert rows[1]["x_wiener"] == 62 * (62 * 62 - 1) // 6
    assert rows[2]["x_four_cycles"] == 15 and rows[2]["x_four_cycle_share"] == 3.0
    with pytest.raises(Exception, match="more than 62"):
        tb.graph_features(graphs, {"x": frame(spark, {1: path(63)})}, ["distance"]).collect()


def test_cliques_and_connectivity_have_no_cap(spark):
    edges = frame(spark, {n: clique(n) for n in (2, 3, 8, 9, 12)} | {20: path(4), 30: [(u, v) for u, v in clique(12) if v - u != 6]})
    assert {r["graph_id"]: r["largest"] for r in tb.largest_clique(edges).collect()} == {2: 2, 3: 3, 8: 8, 9: 9, 12: 12, 20: 2, 30: 6}
    assert {r["graph_id"]: r["vertex_connectivity"] for r in tp.connectivity(edges).collect()} == {2: 1, 3: 2, 8: 7, 9: 8, 12: 11, 20: 1, 30: 10}


def test_walks_beyond_doubles(spark):
    n = 28
    found = tb.walk_traces(frame(spark, {1: clique(n)}), 12).first()["walks"]
    assert found == [((n - 1) ** k + (n - 1) * (-1) ** k) for k in range(2, 13)]
    assert found[-1] > 2**53
    with pytest.raises(Exception, match="2 \\*\\* 63"):
        tb.walk_traces(frame(spark, {1: clique(60)}), 12).collect()


def test_names_are_taken_once():
    with pytest.raises(ValueError, match="triangle_counts"):

        @query()
        def triangle_counts(spark, sf_dir):
            return None


def test_blocks(spark):
    edges = frame(spark, {5: [(0, 1), (3, 4), (4, 7), (8, 11), (2, 9)]})
    assert sorted((r["graph_id"], r["u"], r["v"]) for r in tb.blocks(edges, 4, 3).collect()) == [(15, 0, 1), (16, 0, 3), (17, 0, 3)]
