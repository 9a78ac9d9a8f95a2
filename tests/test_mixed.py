"""Motifs over two layers on graphs small enough to count by hand."""

from graphloom.operators import mixed as mx

SCHEMA = "graph_id long, u int, v int"


def test_mixed_motifs(spark):
    first = [(1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 0, 1), (2, 0, 1), (2, 1, 2), (2, 2, 3), (3, 0, 1), (4, 0, 1), (4, 0, 2), (4, 1, 2)]
    second = [(1, 1, 2), (1, 1, 3), (1, 2, 3), (1, 0, 3), (2, 0, 2), (2, 1, 3), (5, 4, 9)]
    rows = {r["graph_id"]: r for r in mx.mixed_motifs(spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA)).collect()}
    clique, diamond, edge, plain, other = (rows[k] for k in (1, 2, 3, 4, 5))
    # star and triangle: the three triangles at 0 are mixed, the one of the second layer isn't; all three 4-cycles have edges of both
    assert (clique["triangles"], clique["mixed_triangles"], clique["cycles"], clique["mixed_cycles"], clique["cliques"], clique["mixed_cliques"], clique["diamonds"]) == (4, 3, 3, 3, 1, 1, 0)
    assert clique["mixed_triangles_share"] == 0.75 and clique["mixed_triangles_per_set"] == 0.75 and clique["mixed_diamonds_share"] is None
    assert (diamond["triangles"], diamond["diamonds"], diamond["mixed_diamonds"], diamond["cycles"], diamond["mixed_cycles"], diamond["cliques"]) == (2, 1, 1, 1, 1, 0)
    assert (edge["n"], edge["triangles"], edge["mixed_triangles_share"], edge["mixed_triangles_per_set"]) == (2, 0, None, None) and other["n"] == 2
    assert (plain["triangles"], plain["mixed_triangles"], plain["mixed_triangles_share"], plain["mixed_cycles_per_set"]) == (1, 0, 0.0, None)
    none = spark.createDataFrame([], SCHEMA)
    assert mx.mixed_motifs(none, none).count() == 0


def test_square_proxy(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 0, 3), (2, 0, 1), (2, 1, 2)], SCHEMA)
    assert {tuple(r) for r in mx.square_proxy(edges).collect()} == {(1, 2.0), (2, None)}


def test_typed_edges(spark):
    first, second = (spark.createDataFrame(x, SCHEMA) for x in ([(1, 0, 1), (1, 0, 1)], [(1, 0, 1), (1, 1, 2)]))
    assert sorted(map(tuple, mx.typed_edges(first, second).collect())) == [(1, 0, 1, 0), (1, 1, 0, 0), (1, 1, 2, 1), (1, 2, 1, 1)]
