"""Closed walks of small and large graphs in one task each."""

import random
from itertools import combinations

import numpy as np
import pytest

from graphloom.operators import invariants as inv
from graphloom.operators import walks
from graphloom.plans.queries import QUERIES


def powers(edges, longest):
    ids = sorted({x for e in edges for x in e})
    a = np.zeros((len(ids), len(ids)), dtype=object)
    for u, v in edges:
        a[ids.index(u), ids.index(v)] = a[ids.index(v), ids.index(u)] = 1
    power, found = a, {}
    for k in range(2, longest + 1):
        power = power.dot(a)
        if n := int(power.trace()):
            found[k] = n
    return found


def test_closed_walks_stay_with_the_graph(spark, sf):
    rng = random.Random(7)
    graphs = {g: [(3 * u - 5, 3 * v - 5) for u, v in combinations(range(n), 2) if rng.random() < p] for g, (n, p) in enumerate([(3, 1), (9, 0.5), (12, 0.3), (40, 0.2)])}
    graphs[10] = [(0, 1000 * i) for i in range(1, 300)] + [(1000, 2000)]  # a star of 300 ids that are far apart, and a triangle
    graphs[11] = [(i, i + 1) for i in range(399)] + [(0, 399), (0, 2)]
    rows = [(g, u, v) for g, edges in graphs.items() for u, v in edges]
    frame = spark.createDataFrame(rows, "graph_id long, u int, v int")
    expected = {(g, k): n for g in range(4) for k, n in powers(graphs[g], 6).items()}
    star, ring = 299, 400
    expected |= {(10, 2): 2 * (star + 1), (10, 3): 6, (11, 2): 2 * (ring + 1), (11, 3): 6}
    found = {(r["graph_id"], r["k"]): r["walks"] for r in inv.closed_walks(frame, 6).collect()}
    assert {x: n for x, n in found.items() if x[0] < 4 or x[1] < 4} == expected
    plan = QUERIES["closed_walks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_large_graphs_are_as_small_ones(monkeypatch):
    rng = random.Random(8)
    edges = np.array([e for e in combinations(range(70), 2) if rng.random() < 0.2])
    u, v = edges.T
    whole = walks.traces(np.zeros(len(u), "int64"), u, v, 1, 7)
    assert whole[0].tolist() == list(powers(edges.tolist(), 7).values())
    monkeypatch.setattr(walks, "MATRIX", 20)
    monkeypatch.setattr(walks, "ENDS", 500)
    assert (walks.traces(np.zeros(len(u), "int64"), u * 1000, v * 1000, 1, 7) == whole).all()


def test_walks_leave_64_bits():
    u, v = np.array(list(combinations(range(60), 2))).T
    assert walks.traces(np.zeros(len(u), "int64"), u, v, 1, 10)[0].tolist() == [59**k + 59 * (-1) ** k for k in range(2, 11)]
    with pytest.raises(OverflowError):
        walks.traces(np.zeros(len(u), "int64"), u, v, 1, 11)
