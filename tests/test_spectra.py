"""Eigenvectors, their sums, and long cycles, on graphs with closed forms."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from graphloom.operators import cycles as cy
from graphloom.operators import spectra as sp
from graphloom.plans import spectra_queries  # noqa: F401  (registers)
from graphloom.plans.queries import QUERIES


def frame(spark, graphs, fields="graph_id long, u int, v int"):
    return spark.createDataFrame([(g, *e) for g, edges in graphs.items() for e in edges], fields)


def clique(n):
    return list(combinations(range(n), 2))


def test_known_vectors(spark):
    path = [(70, 71), (71, 90)]
    vectors = sp.eigenvectors(frame(spark, {1: path, 2: clique(4), 3: [(0, 1), (1, 2), (2, 3), (0, 3)]}))
    rows = {(r["graph_id"], r["v"], r["k"]): r for r in vectors.collect()}
    assert [rows[1, v, 1]["component"] for v in (70, 71, 90)] == pytest.approx([1 / math.sqrt(2), 0, -1 / math.sqrt(2)], abs=1e-9)
    assert [round(rows[1, 70, k]["value"], 9) for k in range(3)] == [0, 1, 3]
    assert all(rows[2, v, k]["multiplicity"] == 3 and rows[2, v, k]["weight"] == pytest.approx(1 / 4) for v in range(4) for k in (1, 2, 3))
    assert sorted(rows[3, 0, k]["multiplicity"] for k in range(4)) == [1, 1, 2, 2]
    extreme = {(r["graph_id"], r["v"]): r for r in sp.extreme_vectors(vectors).collect()}
    assert extreme[2, 0]["low_1"] == pytest.approx(0.5) and extreme[2, 0]["low_2"] is None and extreme[3, 0]["low_2"] is None
    assert extreme[3, 1]["high_1"] == pytest.approx(-0.5) and extreme[1, 90]["low_3"] == extreme[1, 90]["high_1"]
    place = {(r["graph_id"], r["v"]): r for r in sp.positions(vectors).collect()}
    assert place[1, 71]["fiedler"] == pytest.approx(0, abs=1e-9) and place[2, 0]["fiedler"] is None and place[2, 0]["encoding"] == pytest.approx([0.5, 0.5, 0.5])
    with pytest.raises(ValueError, match="no such matrix"):
        sp.eigenvectors(frame(spark, {1: path}), "other")


def test_spanning_trees_and_signs(spark):
    edges = frame(spark, {n: clique(n) for n in (3, 5, 7)})
    found = {r["graph_id"]: r for r in sp.eigenvalue_products(sp.eigenvectors(edges)).collect()}
    assert all(round(math.exp(found[n]["log_product"]) / n) == n ** (n - 2) and found[n]["zeros"] == 1 and found[n]["total"] == pytest.approx(n * (n - 1)) for n in (3, 5, 7))
    adjacency = {r["graph_id"]: r for r in sp.eigenvalue_products(sp.eigenvectors(edges, "adjacency")).collect()}
    assert [(adjacency[n]["sign"], round(math.exp(adjacency[n]["log_product"]))) for n in (3, 5, 7)] == [(1, 2), (1, 4), (1, 6)]
    signed = frame(spark, {1: [(0, 1, -1.0), (1, 2, 1.0), (0, 2, 1.0)]}, "graph_id long, u int, v int, weight double")
    assert sp.eigenvalue_products(sp.eigenvectors(signed)).first()["zeros"] == 0  # an odd number of negative edges on a triangle: not balanced


def test_all_cycles_of_cliques(spark):
    sizes = (3, 4, 7, 8)
    edges = frame(spark, {n: clique(n) for n in sizes} | {20: [(i, (i + 1) % 11) if i < 10 else (0, 10) for i in range(11)], 30: [(0, 1), (1, 2)]})
    sets = cy.cycle_sets(edges)
    found = {(r["graph_id"], r["length"]): r["cycles"] for r in cy.cycles_by_length(sets).collect()}
    expected = {(n, k): math.comb(n, k) * math.factorial(k - 1) // 2 for n in sizes for k in range(3, n + 1)}
    assert found == expected | {(20, 11): 1}
    shares = {(r["graph_id"], r["length"]): r["share"] for r in cy.cycle_shares(sets, edges).collect()}
    assert shares[7, 5] == math.factorial(4) / 2 and shares[20, 11] == 1
    through = {(r["graph_id"], r["v"]): (r["cycles"], r["max_length"]) for r in cy.cycles_through(sets).collect()}
    assert through[4, 0] == (3 + 3, 4) and through[20, 5] == (1, 11) and not any(g == 30 for g, _ in through)


def test_residuals_stay_with_the_graph(spark, sf):
    for kind in ("laplacian", "adjacency"):
        found = {r["graph_id"]: r for r in sp.residuals(frame(spark, {1: [(70, 71), (71, 90)], 2: clique(4), 3: [(0, 1), (2, 3)], 4: clique(30)}), kind).collect()}
        assert {g: r["vectors"] for g, r in found.items()} == {1: 3, 2: 4, 3: 4, 4: 30}
        assert all(r["residual"] < 1e-9 and r["overlap"] < 1e-9 for r in found.values())
    signed = frame(spark, {1: [(0, 1, -1.0), (1, 2, 2.5), (0, 2, 1.0)]}, "graph_id long, u int, v int, weight double")
    assert sp.residuals(signed).first()["residual"] < 1e-9
    plan = QUERIES["eigenvector_residuals"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def brute_cycles(edges, longest):
    """Vertex sets of simple cycles, once for each cycle."""
    near, found = {}, []
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)

    def walk(path):
        found.extend([frozenset(path)] * (len(path) > 2 and path[0] in near[path[-1]] and path[1] < path[-1]))
        if len(path) < longest:
            for y in near[path[-1]]:
                if y > path[0] and y not in path:
                    walk([*path, y])

    for a in near:
        walk([a])
    return found


def test_cycles_stay_with_the_graph(spark, sf):
    """Small and large ids, dense and sparse graphs, odd and even bounds, against every path walked."""
    rng = random.Random(6)
    graphs = {g: [e for e in combinations(range(n), 2) if rng.random() < p] for g, (n, p) in enumerate([(6, 1), (12, 0.3), (16, 0.25), (17, 0.2), (20, 0.15), (40, 0.03), (9, 0.6), (12, 0.25)])}
    graphs[20] = [(u + 45, v + 45) for u, v in combinations(range(7), 2)]
    graphs[21] = [(i, i + 1) for i in range(62)] + [(0, 10), (52, 62), (0, 62)]
    edges = frame(spark, {g: e for g, e in graphs.items() if e})
    for longest in (11, 6):
        walked = {g: brute_cycles(e, longest) for g, e in graphs.items()}
        sets = cy.cycle_sets(edges, longest)
        expected = {(g, sum(1 << v for v in s)): n for g, found in walked.items() for s, n in Counter(found).items()}
        assert {(r["graph_id"], r["seen"]): r["cycles"] for r in sets.collect()} == expected
        counts, shares = cy.cycle_counts(edges, longest), cy.cycle_shares(sets, edges)
        assert sorted(counts.collect()) == sorted(shares.collect()) and counts.schema == shares.schema
        through, before = cy.cycle_vertices(edges, longest), cy.cycles_through(sets)
        assert sorted(through.collect()) == sorted(before.collect()) and through.dtypes == before.dtypes
    assert cy.cycle_sets(edges.where("graph_id < 0")).count() == 0
    for name in ("long_cycles", "long_cycles_through"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1


def test_cycles_of_many_paths_start_anew(monkeypatch):
    masks = np.array([[(1 << 10) - 1 - (1 << v) for v in range(10)]] * 7)
    whole = {length: ways.sum() for group in cy._cycles(masks, 10) for length, (_, _, ways) in group}
    monkeypatch.setattr(cy, "PATHS", 3000)
    parts = list(cy._cycles(masks, 10))
    assert len(parts) > 1 and sorted({int(x) for group in parts for _, (g, _, _) in group for x in g}) == list(range(7))
    assert whole == {k: sum(ways.sum() for group in parts for length, (_, _, ways) in group if length == k) for k in whole}
    assert whole == {k: 7 * 2 * math.comb(10, k) * math.factorial(k - 1) // 2 for k in range(3, 11)}
