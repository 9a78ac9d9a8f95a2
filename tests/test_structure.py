"""Structure operators on graphs whose values are known in closed form."""

import math

from graphloom.operators import structure as st


def graphs(spark):
    clique = [(1, a, b) for a in range(4) for b in range(a + 1, 4)]
    path = [(2, a, a + 1) for a in range(4)]
    apart = [(3, 0, 5), (3, 2, 3)]  # two components, ids with gaps
    return spark.createDataFrame(clique + path + apart, "graph_id long, u int, v int")


def test_spectra(spark):
    rows = {r["graph_id"]: r for r in st.spectral_descriptors(graphs(spark)).collect()}
    assert math.isclose(rows[1]["energy"], 6) and math.isclose(rows[1]["connectivity"], 4) and math.isclose(rows[1]["kirchhoff"], 3)
    assert math.isclose(rows[1]["heat_1_0"], 1 + 3 * math.exp(-4)) and math.isclose(rows[1]["estrada"], math.exp(3) + 3 * math.exp(-1))
    assert math.isclose(rows[2]["kirchhoff"], 20) and math.isclose(rows[2]["connectivity"], 2 - 2 * math.cos(math.pi / 5))
    assert math.isclose(rows[3]["connectivity"], 0, abs_tol=1e-9) and math.isclose(rows[3]["energy"], 4) and math.isclose(rows[3]["laplacian_square"], 8)
    kinds = st.spectrum(graphs(spark)).where("graph_id = 3 and kind = 'normalised'").orderBy("k").collect()
    assert [round(r["value"], 9) + 0.0 for r in kinds] == [0, 0, 2, 2]


def test_scores_and_cuts(spark):
    scores = {(r["graph_id"], r["v"]): r for r in st.vertex_scores(graphs(spark)).collect()}
    assert [round(scores[2, v]["betweenness"] * 6, 9) for v in range(5)] == [0, 3, 4, 3, 0]
    assert {scores[1, v]["core"] for v in range(4)} == {3} and {scores[2, v]["core"] for v in range(5)} == {1}
    assert math.isclose(scores[3, 5]["closeness"], 1 / 3) and all(math.isclose(scores[3, v]["pagerank"], 0.25) for v in (0, 2, 3, 5))
    cuts = {r["graph_id"]: (r["cut_points"], r["bridges"]) for r in st.cut_counts(graphs(spark)).collect()}
    assert cuts == {1: (0, 0), 2: (3, 4), 3: (0, 2)}


def test_no_rows(spark):
    none = graphs(spark).where("graph_id < 0")
    for f in (st.vertex_scores, st.spectral_descriptors, st.cut_counts, st.induced_four, st.simple_cycles, st.colour_summary, st.distance_profile, st.euler_summary, st.vertex_orbits, st.cycle_membership, st.laplacian_prefix, st.heat_signature):
        assert f(none).count() == 0


def test_orbits_cycles_and_prefixes(spark):
    orbits = {(r["v"], r["degrees"], r["own"]): r["sets"] for r in st.vertex_orbits(graphs(spark)).where("graph_id = 2").collect()}
    assert orbits == {(0, "1122", 1): 1, (1, "1122", 2): 1, (2, "1122", 2): 2, (3, "1122", 1): 1, (3, "1122", 2): 1, (1, "1122", 1): 1, (4, "1122", 1): 1}
    on = {(r["graph_id"], r["v"]): (r["cycles"], r["mean_length"], r["max_length"]) for r in st.cycle_membership(graphs(spark)).collect()}
    assert on == {(1, v): (6, 3.5, 4) for v in range(4)}
    low = {r["graph_id"]: [r[f"lap_{k}"] for k in range(6)] for r in st.laplacian_prefix(graphs(spark)).collect()}
    assert [round(x, 9) for x in low[1][:4]] == [0, 4, 4, 4] and low[1][4:] == [None, None]
    heat = {r["graph_id"]: r for r in st.heat_signature(graphs(spark), 2, 0.5, 1.0).collect()}
    assert all(math.isclose(heat[1]["trace"][k], 1 + 3 * math.exp(-4 * t)) for k, t in enumerate((0.5, 1.0)))


def test_dual_estimates(spark):
    from graphloom.operators.invariants import dual_estimates

    rows = {(r["graph_id"], r["v"]): tuple(r)[2:] for r in dual_estimates(graphs(spark)).collect()}
    assert rows[1, 0] == (4, 1.0, 4 / 3, 4.0, 1.0)  # in the 4-clique: three triangles, degree three
    assert rows[2, 0] == (1, 0.0, 1.0, 0.0, 0.5) and rows[2, 1] == (1, 0.0, 0.5, 0.0, 1 / 3) and len(rows) == 13
