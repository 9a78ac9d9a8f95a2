"""The wide row against the operators whose values it has, and its plan."""

import random

import pytest

from graphloom.operators import invariants as inv
from graphloom.operators import structure as st
from graphloom.operators import tables as tb
from graphloom.plans.queries import QUERIES
from graphloom.plans.table_queries import layered_edges, layers


def collection(spark):
    rng, rows = random.Random(4), []
    for g in range(60):
        n, p = rng.choice([2, 3, 5, 8, 12, 20]), rng.random()
        rows += [(g, u, v) for u in range(n) for v in range(u + 1, n) if rng.random() < p]
    return spark.createDataFrame(rows, "graph_id long, u int, v int")


def by_graph(frame):
    return {r["graph_id"]: r.asDict() for r in frame.collect()}


def test_wide_row_is_that_of_the_operators(spark):
    edges = collection(spark)
    graphs = spark.range(61).toDF("graph_id").selectExpr("graph_id", "cast(graph_id as string) as name")
    wide = by_graph(tb.graph_features(graphs, {"x": edges, "y": edges.limit(0)}, "counted"))
    assert len(wide) == 61 and all(wide[60][c] is None for c in wide[60] if c not in ("graph_id", "name")) and wide[7]["name"] == "7"
    parts = [inv.degree_summary, inv.degree_entropy, inv.assortativity, inv.degree_gini, inv.triangle_counts, inv.four_cycles, inv.distance_summary, inv.embeddedness, st.distance_profile, st.cut_counts, lambda e: st.euler_summary(e).drop("bars")]
    for part in parts:
        found = by_graph(part(edges))
        for g, row in wide.items():
            for c in next(iter(found.values())):
                if c != "graph_id":
                    held = found[g][c] if g in found else None
                    assert row[f"x_{c}"] == (held if held is None else pytest.approx(held, abs=1e-9)), (g, c)
                    assert row[f"y_{c}"] is None
    fours = by_graph(st.induced_four(edges))
    assert all(row[f"x_induced_{c}"] == (fours[g][c] if g in fours else None) for g, row in wide.items() for c in [*st.FOUR.values(), "connected_sets"])


def test_wide_row_takes_one_shuffle_of_edges(spark, sf):
    plan = QUERIES["graph_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4


def test_layered_edges_are_those_of_the_layers(spark, sf):
    held = layered_edges(spark, sf)
    for k, edges in enumerate(layers(spark, sf).values()):
        one = sorted(map(tuple, held.where(f"layer = {k}").select("graph_id", "u", "v").collect()))
        assert one == sorted(map(tuple, edges.select("graph_id", "u", "v").collect()))
