"""Wide feature rows, vertex names and score comparisons on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import preparation as prep
from graphloom.operators import scores, tables

EDGES = "graph_id long, u int, v int"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_wide_row(spark):
    far = 10**6
    edges = spark.createDataFrame([(1, 0, far), (1, far, far + 5), (1, 0, far + 5), (2, 3, 4)], EDGES)
    graphs = spark.createDataFrame([(1,), (2,), (3,)], "graph_id long")
    found = {r["graph_id"]: r for r in tables.graph_features(graphs, {"den": edges, "num": edges.limit(0)}).collect()}
    assert set(found) == {1, 2, 3}  # a graph without edges keeps its row
    assert found[1]["den_triangles"] == 1 and found[1]["den_diameter"] == 1 and found[1]["den_n_nodes"] == 3
    assert found[3]["den_n_nodes"] is None and found[1]["num_n_edges"] is None
    assert found[2]["den_assortativity"] is None and found[2]["den_deg_skew"] is None
    few = tables.graph_features(graphs, {"den": edges}, "fast")
    assert "den_triangles" not in few.columns and "den_gini" in few.columns
    with pytest.raises(ValueError, match="no such groups"):
        tables.graph_features(graphs, {"den": edges}, ["degree", "nothing"])


def test_too_many_vertices(spark):
    path = spark.range(70).select(F.lit(1).cast("long").alias("graph_id"), F.col("id").cast("int").alias("u"), (F.col("id") + 1).cast("int").alias("v"))
    with pytest.raises(Exception, match="more than 62 vertices"):
        tables.graph_features(path.select("graph_id").distinct(), {"den": path}, ["distance"]).collect()


def test_relabelled(spark):
    edges = spark.createDataFrame([(1, -5, 90), (1, 90, 7000), (2, 1, 2)], EDGES)
    assert rows(tables.relabelled(edges)) == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]


def test_texts(spark):
    texts = spark.createDataFrame([(1, "{1, 3, 99}"), (2, "{}"), (3, None)], "graph_id long, text string")
    assert rows(tables.decoded_edges(texts, 4)) == [(1, 1, 0, 1), (1, 3, 0, 3)]
    assert sorted(tables.numerators(spark.createDataFrame([(1, "{{1, 2}, {}}")], "graph_id long, text string")).collect(), key=str) == [(1, 0, 1), (1, 0, 2), (1, 1, None)]
    assert rows(tables.coefficients(spark.createDataFrame([(1, "{1, -3/2}")], "graph_id long, text string"))) == [(1, 0, 1.0), (1, 1, -1.5)]


def test_closed_forms(spark):
    k4 = spark.createDataFrame([(1, a, b) for a in range(4) for b in range(a + 1, 4)] + [(2, a, (a + 1) % 5) if a < 4 else (2, 0, 4) for a in range(5)], EDGES)
    walks = {r["graph_id"]: r["walks"] for r in tables.walk_traces(k4, 5).collect()}
    assert walks[1] == [12, 24, 84, 240] and walks[2] == [10, 0, 30, 10]
    assert rows(tables.largest_clique(k4)) == [(1, 4), (2, 2)]
    assert {(r["graph_id"], r["length"]): r["paths"] for r in tables.path_counts(k4).collect()} == {(1, 3): 12, (2, 3): 5, (2, 4): 5}


def test_correlations_with_gaps(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (None, 9.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    found = {(r["i"], r["j"]): r["corr"] for r in prep.correlations(frame, ["a", "b", "c"]).collect()}
    assert found[0, 1] == pytest.approx(1.0) and found[0, 2] is None
    assert prep.without_nulls(frame, []).columns == ["b", "c"]
    assert prep.validation_share(100) == 0.1 and prep.validation_share(10**6) == 0.05


def test_curve_and_ranks(spark):
    points = spark.createDataFrame([(1, 0.0, 0.2), (1, 0.5, 0.6), (1, 1.0, 1.0)], "loop int, x double, y double")
    value = {r["step"]: r["value"] for r in scores.curve_on_grid(points, ["loop"], "x", "y", 4).collect()}
    assert value == pytest.approx({0: 0.2, 1: 0.4, 2: 0.6, 3: 0.8, 4: 1.0})
    ranked = scores.score_ranks(spark.createDataFrame([(1, 0.5), (1, 0.5), (1, 0.1), (1, 0.5001)], "loop int, p double"), ["loop"], "p")
    assert sorted(r["place"] for r in ranked.collect()) == [1, 2, 2, 4]
