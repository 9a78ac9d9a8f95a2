"""Kernels, documents and samples on graphs whose values are known, and on larger ones than masks take."""

import hashlib
import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import kernels as kn
from graphloom.operators import sampling as sm
from graphloom.operators import structure as st


@pytest.fixture(scope="module")
def edges(spark):
    clique = [(1, a, b) for a, b in combinations(range(5), 2)]
    path = [(2, a, a + 1) for a in range(6)]
    moved = [(3, min(a, b), max(a, b)) for a, b in ((6, 0), (0, 3), (3, 5), (5, 1), (1, 2), (2, 4))]  # the path again
    apart = [(4, 0, 5), (4, 2, 3), (4, 3, 7)]
    return spark.createDataFrame(clique + path + moved + apart, "graph_id long, u int, v int").cache()


def test_histogram_is_that_of_the_colours(edges):
    for rounds in (0, 2):
        plain = {(r["graph_id"], r["colour"]): r["k"] for r in st.vertex_colours(edges, rounds).groupBy("graph_id", "colour").agg(F.count(F.lit(1)).alias("k")).collect()}
        assert {(r["graph_id"], r["colour"]): r["k"] for r in kn.subtree_histogram(edges, 2).where(F.col("round") == rounds).collect()} == plain


def test_kernels(spark, edges):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (2, 3), (4, 4), (1, 99), (None, 2), (2, 4)], "a long, b long")
    found = {(r["a"], r["b"]): (r["dot"], round(r["kernel"], 9)) for r in kn.pair_kernels(kn.subtree_histogram(edges), pairs).collect()}
    assert set(found) == {(1, 2), (2, 3), (4, 4), (2, 4)}
    assert found[1, 2] == (0, 0) and found[2, 3][1] == found[4, 4][1] == 1 and 0 < found[2, 4][1] < 1


def test_documents(edges):
    rows = kn.hashed_documents(kn.subtree_histogram(edges), 64)
    by = {}
    for r in rows.collect():
        by.setdefault(r["graph_id"], {})[r["bucket"]] = r["weight"]
    assert all(math.isclose(sum(x * x for x in d.values()), 1) for d in by.values())
    assert by[2].keys() == by[3].keys() and all(math.isclose(by[2][b], by[3][b]) for b in by[2])
    vectors = {r["graph_id"]: r["vector"] for r in kn.document_vectors(rows, 64).collect()}
    assert all(len(x) == 64 and [i for i, y in enumerate(x) if y] == sorted(by[g]) for g, x in vectors.items())


def test_common_and_rare_words_weigh_alike(edges, monkeypatch):
    histogram = kn.subtree_histogram(edges)
    plain = sorted(map(tuple, kn.hashed_documents(histogram, 64).collect()))
    monkeypatch.setattr(kn, "COMMON", 2)  # words of at most two of four graphs now go the other way
    other = sorted(map(tuple, kn.hashed_documents(histogram, 64).collect()))
    assert [x[:2] for x in plain] == [x[:2] for x in other] and all(math.isclose(a[2], b[2]) for a, b in zip(plain, other, strict=True))


def test_full_rate_is_exact(edges):
    exact = {(r["graph_id"], r["v"]): r["betweenness"] for r in st.vertex_scores(edges).collect()}
    found = {(r["graph_id"], r["v"]): r["betweenness"] for r in sm.pivot_betweenness(edges, 10).collect()}
    assert found.keys() == exact.keys() and all(math.isclose(found[x], exact[x], abs_tol=1e-12) for x in exact)
    profile = {r["graph_id"]: r for r in st.distance_profile(edges).collect()}
    for r in sm.sampled_distances(edges, 10).collect():
        p = profile[r["graph_id"]]
        assert r["distance_error"] == 0 and r["sources"] == r["n_nodes"] and math.isclose(r["effective_diameter"], p["effective_diameter"])
        assert r["graph_id"] == 4 or math.isclose(r["distance_mean"], p["mean_distance"]) and math.isclose(r["ecc_mean"], p["ecc_mean"]) and math.isclose(r["ecc_p90"], p["ecc_p90"])
    for k in (4, 5):
        whole = {tuple(r) for r in st.induced_classes(edges, k).collect()}
        for sample in (sm.sampled_classes(edges, k), sm.sampled_classes(edges, k, most=1000)):
            rows = sample.collect()
            assert {tuple(r)[:5] for r in rows} == whole and all(math.isclose(r["estimate"], r["sets"]) and r["error"] == 0 for r in rows)


def test_large_graph_and_blocks(spark, monkeypatch):
    """A ring of 3,000 vertices, beyond masks and matrices: all sources see the same, so any sample is right."""
    n = 3000
    ring = spark.range(n).select(F.lit(1).cast("long").alias("graph_id"), F.least("id", (F.col("id") + 1) % n).cast("int").alias("u"), F.greatest("id", (F.col("id") + 1) % n).cast("int").alias("v"))
    monkeypatch.setattr(sm, "CELLS", 4 * n)  # two roots a block
    r = sm.sampled_distances(ring, 5).first()
    assert (r["n_nodes"], r["sources"], r["ecc_mean"]) == (n, 5, n / 2) and math.isclose(r["distance_mean"], n * n / 4 / (n - 1)) and r["distance_error"] < 1e-9
    total = sm.pivot_betweenness(ring, 5).agg(F.sum("betweenness"), F.count(F.lit(1))).first()
    assert total[1] == n and math.isclose(total[0], n * (n * n / 4 - (n - 1)) / ((n - 1) * (n - 2)))  # inner vertices of all paths


def test_samples_repeat_and_bound(edges):
    for kwargs in ({"most": 3}, {"share": 0.3}):
        a, b = (sorted(map(tuple, sm.sampled_classes(edges, 4, **kwargs).collect())) for _ in range(2))
        assert a == b
    drawn = sm.sampled_classes(edges, 4, most=3).groupBy("graph_id").agg(F.sum("sets")).collect()
    assert all(x[1] <= 3 for x in drawn) and {x[0]: x[1] for x in drawn}[1] == 3
    one = sm.sampled_distances(edges, 1, exact_to=0)
    assert {r["distance_error"] for r in one.collect()} == {None}


def test_no_rows(spark, edges):
    none = edges.where("graph_id < 0")
    histogram = kn.subtree_histogram(none)
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    for found in (histogram, kn.pair_kernels(histogram, pairs), kn.hashed_documents(histogram), sm.pivot_betweenness(none, 3), sm.sampled_distances(none), sm.sampled_classes(none, 4, most=3)):
        assert found.count() == 0


def test_drawn_sets_are_those_of_the_least_digests(spark):
    """Few and many sets, names that no block of MD5 has room for, and no sort of sets."""
    rng = random.Random(2)
    graphs = {g: [e for e in combinations(range(n), 2) if rng.random() < 0.5] for g, n in ((3, 4), (7, 12), (8, 12), (40, 12), (123456, 9), (9, 20), (-(10**18), 12))}
    frame = spark.createDataFrame([(g, u, v) for g, edges in graphs.items() for u, v in edges], "graph_id long, u int, v int")
    for seed in (42, -(10**17)):
        expected = {}
        for g, edges in graphs.items():
            sets = sorted(combinations(sorted({x for e in edges for x in e}), 5), key=lambda s: hashlib.md5(":".join(map(str, (g, *s, seed))).encode()).hexdigest())[:30]
            for drawn in sets:
                held = class_of([e for e in edges if set(e) <= set(drawn)], drawn)
                if held:
                    expected[g, *held] = expected.get((g, *held), 0) + 1
        sample = sm.sampled_classes(frame, 5, most=30, seed=seed)
        assert {(r["graph_id"], r["n_edges"], r["degrees"], r["triangles"]): r["sets"] for r in sample.collect()} == expected
        plan = sample._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Generate explode(if" not in plan


def class_of(edges, drawn):
    """Edges, sorted degrees and triangles of a connected graph; None of another."""
    near = {v: {x for e in edges if v in e for x in e} - {v} for v in drawn}
    reached = {drawn[0]}
    for _ in drawn:
        reached |= {x for v in reached for x in near[v]}
    if len(reached) < len(drawn):
        return None
    return len(edges), "".join(map(str, sorted(map(len, near.values())))), sum(b in near[a] and c in near[a] and c in near[b] for a, b, c in combinations(drawn, 3))
