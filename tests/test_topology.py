"""Topology operators on graphs whose values are known in closed form."""

import math

from graphloom.operators import topology as tp


def graphs(spark):
    clique = [(1, a, b) for a in range(6) for b in range(a + 1, 6)]
    ring = [(2, a, a + 1) for a in range(5)] + [(2, 0, 5)]
    apart = [(3, 0, 5), (3, 2, 3)]  # two components, ids with gaps
    bow = [(4, 0, 1), (4, 0, 2), (4, 1, 2), (4, 2, 3), (4, 2, 4), (4, 3, 4)]
    return spark.createDataFrame(clique + ring + apart + bow, "graph_id long, u int, v int")


def test_connectivity(spark):
    found = {r[0]: (r[1], r[2]) for r in tp.connectivity(graphs(spark)).collect()}
    assert found == {1: (5, 5), 2: (2, 2), 3: (0, 0), 4: (1, 2)}


def test_faces(spark):
    rows = {r["graph_id"]: r for r in tp.face_summary(tp.ascending_rotation(graphs(spark))).collect()}
    assert (rows[2]["n_faces"], rows[2]["face_max"]) == (2, 6) and rows[3]["n_faces"] == 2
    total = {g: r["n_faces"] * r["face_mean"] for g, r in rows.items()}
    assert all(math.isclose(total[g], 2 * m) for g, m in ((1, 15), (2, 6), (3, 2), (4, 6)))
    assert (6 - 15 + rows[1]["n_faces"]) % 2 == 0


def test_communities_and_scores(spark):
    edges = graphs(spark)
    rows = {r["graph_id"]: r for r in tp.community_summary(edges, tp.communities(edges)).collect()}
    assert rows[1]["communities"] == 1 and math.isclose(rows[1]["modularity"], 0, abs_tol=1e-12)
    assert rows[3]["communities"] == 2 and math.isclose(rows[3]["modularity"], 0.5)
    scores = tp.spreading_scores(edges).where("graph_id = 1").collect()
    assert all(math.isclose(r[c], 1 / math.sqrt(6)) for r in scores for c in ("eigenvector", "katz"))


def test_growth(spark):
    two = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 0, 3), (1, 1, 3)], "graph_id long, u int, v int")
    child = {(r["u"], r["v"]): r["exponent"] for r in tp.grown(two).collect()}
    assert child == {(0, 2): -1, (1, 2): -1, (0, 3): -1, (1, 3): -1, (0, 4): -1, (1, 4): -1, (2, 4): -1, (3, 4): -1, (2, 3): 1}


def test_no_rows(spark):
    none = graphs(spark).where("graph_id < 0")
    for f in (tp.connectivity, tp.communities, tp.spreading_scores, tp.grown, lambda e: tp.face_summary(tp.ascending_rotation(e))):
        assert f(none).count() == 0
