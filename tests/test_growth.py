"""Canonical forms, rotation texts, growth over levels, pattern search and relations."""

from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import growth as gr
from graphloom.operators import isomorphism as iso
from graphloom.operators import topology as tp

PAIRS = "graph_id long, u int, v int"


def frame(spark, graphs, fields=PAIRS):
    return spark.createDataFrame([(g, *e) for g, edges in graphs.items() for e in edges], fields)


def matrix(n, edges):
    a = np.zeros((n, n), int)
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    return a


def renamed(edges, seed):
    names = np.random.default_rng(seed).permutation(60)
    return [(int(min(names[u], names[v])), int(max(names[u], names[v]))) for u, v in edges]


def rook():
    return [(x, y) for x, y in combinations(range(16), 2) if x // 4 == y // 4 or x % 4 == y % 4]


def shrikhande():
    return sorted({(min(x, y), max(x, y)) for x in range(16) for dx, dy in ((0, 1), (1, 0), (1, 1)) for y in [(x // 4 + dx) % 4 * 4 + (x % 4 + dy) % 4]})


def test_all_graphs_of_six_vertices():
    pairs = list(combinations(range(6), 2))
    stack = np.stack([matrix(6, [p for i, p in enumerate(pairs) if k >> i & 1]) for k in range(1 << 15)])
    keys = {shape.tobytes() for _, shape in iso.canonical_stack(stack, np.ones((1 << 15, 6), bool))}
    assert len(keys) == 156


def test_regular_graphs(spark):
    cubic = {"prism": [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (0, 3), (1, 4), (2, 5)], "k33": [(u, v) for u in range(3) for v in range(3, 6)]}
    kinds = {"rook": rook(), "shrikhande": shrikhande(), "two triangles": [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)], "hexagon": [(i, (i + 1) % 6) for i in range(6)], "matching": [(2 * i, 2 * i + 1) for i in range(8)]} | cubic
    graphs = {10 * k + c: renamed(e, 10 * k + c) for k, e in enumerate(kinds.values()) for c in range(4)}
    found = {r["graph_id"]: (r["class_id"], r["members"]) for r in iso.isomorphism_classes(frame(spark, graphs)).collect()}
    assert found == {g: (g // 10 * 10, 4) for g in graphs}
    form = iso.canonical_forms(frame(spark, {1: graphs[0]})).first()
    place = {v: i for i, v in enumerate(form["vertices"])}
    assert sorted(tuple(sorted((place[u], place[v]))) for u, v in graphs[0]) == sorted((e["u"], e["v"]) for e in form["edges"])


def test_colours_count(spark):
    square = [(0, 1), (1, 2), (2, 3), (0, 3)]
    coloured = {1: [(*e, -1) for e in square] + [(0, 2, 2)], 2: [(*e, -1) for e in square] + [(1, 3, 2)], 3: [(*e, -1) for e in square] + [(0, 2, 1)], 4: [(0, 1, -1), (1, 2, -1), (2, 3, -1), (0, 3, 2), (0, 2, -1)]}
    edges = frame(spark, coloured, PAIRS + ", colour long")
    keys = {r["graph_id"]: r["key"] for r in iso.canonical_forms(edges).collect()}
    assert keys[1] == keys[2] and len({keys[1], keys[3], keys[4]}) == 3
    plain = iso.decorated(edges)
    assert plain.where("graph_id = 1").count() == 4 + 4 and plain.where("graph_id = 3").count() == 4 + 3
    back = {(r["graph_id"], r["u"], r["v"], r["colour"]) for r in iso.undecorated(plain).collect()}
    assert back == {(g, *e) for g, es in coloured.items() for e in es}
    listed = iso.canonical_forms(edges.where("graph_id in (2, 4)")).select(F.col("graph_id").alias("position"), "key")
    assert {r["graph_id"]: r["position"] for r in iso.looked_up(iso.canonical_forms(edges), listed).collect()} == {1: 2, 2: 2, 3: None, 4: 4}


#: The octahedron's rotation system, and the edges proper and numerators of the graphs that grow from it, as places in the list of pairs of vertices.
OCTAHEDRON = "{{3, 5, 4, 6}, {3, 6, 4, 5}, {1, 6, 2, 5}, {1, 5, 2, 6}, {1, 3, 2, 4}, \n {1, 4, 2, 3}}"
KNOWN = {7: [([3, 4, 5, 6, 7, 9, 10, 11, 12, 14, 15, 17, 18, 19, 20], [21])], 8: [([3, 5, 6, 7, 8, 10, 11, 13, 15, 16, 17, 19, 21, 22, 24, 25, 26, 27], [23, 28]), ([4, 5, 6, 7, 8, 9, 12, 13, 16, 17, 18, 19, 21, 22, 24, 25, 26, 27], [28, 28])]}


def known(n):
    pairs = list(combinations(range(1, n + 1), 2))
    out = {}
    for g, (den, num) in enumerate(KNOWN[n]):
        out[g] = [(*pairs[k - 1], -1) for k in den] + [(*pairs[k - 1], num.count(k)) for k in sorted(set(num))]
    return out


def octahedron(spark):
    rotation = gr.parsed_rotation(spark.createDataFrame([(1, OCTAHEDRON)], "graph_id long, text string"))
    signed = rotation.where("v < nbr").select("graph_id", F.col("v").alias("u"), F.col("nbr").alias("v"), F.lit(-1).cast("long").alias("exponent"))
    return gr.Level(signed, rotation, spark.createDataFrame([(1, 1)], "graph_id long, coefficient long"))


def test_levels_from_the_octahedron(spark):
    start = octahedron(spark)
    assert gr.rotation_faults(start.rotation, start.signed).count() == 0
    assert tp.face_summary(start.rotation).select("n_faces", "faces_3").first() == (8, 8)
    assert gr.growth_places(start.rotation).groupBy("kind").count().collect() == [("triangles", 12)]
    for n, level in zip((7, 8), gr.levels(start, 2), strict=True):
        expected = {r["key"] for r in iso.canonical_forms(frame(spark, known(n), PAIRS + ", colour long")).collect()}
        rows = level.graphs.collect()
        assert {r["key"] for r in rows} == expected and len(rows) == len(expected) and {r["coefficient"] for r in rows} == {1}
        proper = level.signed.where("exponent < 0").select("graph_id", "u", "v")
        assert gr.rotation_faults(level.rotation, proper).count() == 0
        # a rotation system of a connected graph in the plane: n - m + f = 2
        faces = {r["graph_id"]: r["n_faces"] for r in tp.face_summary(level.rotation).collect()}
        sizes = {r["graph_id"]: r["m"] for r in proper.groupBy("graph_id").agg(F.count("u").alias("m")).collect()}
        assert all(n - sizes[g] + f == 2 for g, f in faces.items()) and len(faces) == len(rows)
        assert gr.unique_denominators(level.signed).count() == len(expected)


def test_square_faces(spark):
    cube = {1: [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)]}
    order = {0: (1, 3, 4), 1: (0, 5, 2), 2: (1, 6, 3), 3: (0, 2, 7), 4: (0, 7, 5), 5: (1, 4, 6), 6: (2, 5, 7), 7: (3, 6, 4)}
    rotation = spark.createDataFrame([(1, v, i, w) for v, ws in order.items() for i, w in enumerate(ws)], "graph_id long, v int, pos int, nbr int")
    places = gr.growth_places(rotation)
    assert {r["kind"] for r in places.collect()} == {"square"} and places.count() == 6
    signed = frame(spark, {1: [(min(e), max(e), -1) for e in cube[1]]}, PAIRS + ", exponent long")
    level = gr.next_level(gr.Level(signed, rotation, spark.createDataFrame([(1, 3)], "graph_id long, coefficient long")))
    assert level.graphs.count() == 1 and level.graphs.first()["coefficient"] == 3
    assert level.signed.groupBy("exponent").count().orderBy("exponent").collect() == [(-1, 16), (1, 2)]


def test_rotation_texts(spark):
    texts = spark.createDataFrame([(1, "{{2, 3}, {1,3}, {1, 2}}"), (2, "{}"), (3, None), (4, "{{2}, {1}, {}, {5}, {4}}"), (5, "{{2, 2, 3}, {1}}")], "graph_id long, text string")
    rotation = gr.parsed_rotation(texts)
    assert {r["graph_id"]: r["text"] for r in gr.rotation_texts(rotation).collect()} == {1: "{{2, 3}, {1, 3}, {1, 2}}", 4: "{{2}, {1}, {}, {5}, {4}}", 5: "{{2, 2, 3}, {1}}"}
    edges = frame(spark, {1: [(1, 2), (1, 3), (2, 3)], 4: [(1, 2), (4, 5)], 5: [(1, 2), (2, 3)]})
    assert {tuple(r) for r in gr.rotation_faults(rotation, edges).collect()} == {(5, 1, 2, "repeated"), (5, 1, 3, "no edge"), (5, 2, 3, "missing"), (5, 3, 2, "missing")}


def brute_matches(n, edges, pattern):
    near = {(u, v) for u, v in edges} | {(v, u) for u, v in edges}
    names = sorted({v for e in pattern for v in e})
    found = set()
    for p in permutations(range(n), len(names)):
        at = dict(zip(names, p, strict=True))
        if all((at[u], at[v]) in near for u, v in pattern):
            found.add(frozenset(frozenset((at[u], at[v])) for u, v in pattern))
    return found


@pytest.mark.parametrize("pattern", [gr.HEXAGON, [(1, 2), (2, 3), (1, 3), (3, 4)], [(1, 2), (2, 3), (3, 4), (1, 4)]])
def test_patterns(spark, pattern):
    rng = np.random.default_rng(4)
    n = 8 if len(pattern) > 5 else 7
    graphs = {g: [(u, v) for u, v in combinations(range(n), 2) if rng.random() < (0.8 if n == 8 else 0.5)] for g in range(3)}
    rows = gr.pattern_matches(frame(spark, graphs), pattern).collect()
    names = sorted({v for e in pattern for v in e})
    for g, edges in graphs.items():
        mine = [frozenset(frozenset((r[f"p{u}"], r[f"p{v}"])) for u, v in pattern) for r in rows if r["graph_id"] == g]
        assert len(mine) == len(set(mine)) and set(mine) == brute_matches(n, edges, pattern)
    assert len(gr._symmetries(names, {v: {w for e in pattern for w in e if v in e and w != v} for v in names})) == {15: 4, 4: 2 if (3, 4) in pattern and (1, 3) in pattern else 8}[len(pattern)]


def test_sideways(spark):
    signed = {1: [(min(e), max(e), -1) for e in gr.HEXAGON] + [(3, 7, 2), (5, 8, 1)], 2: [(min(e), max(e), -1) for e in gr.HEXAGON] + [(1, 4, 1)]}
    rows = gr.sideways(frame(spark, signed, PAIRS + ", exponent long")).collect()
    assert {r["graph_id"] for r in rows} == {1}
    assert {(r["u"], r["v"], r["exponent"]) for r in rows if r["exponent"] > 0} == {(3, 8, 2), (5, 7, 1)}
    assert len(rows) == 17


def test_relations(spark):
    points = spark.createDataFrame([(1, 0, 1, [5, 5, 6], 2), (2, 0, 1, [], 0)], "relation long, v int, w int, points array<int>, n int")
    assert sorted((r["relation"], r["first"], r["second"]) for r in gr.redistributed(points).collect()) == [(1, [5, 5], [6]), (1, [5, 6], [5]), (2, [], [])]
    relations = spark.createDataFrame([(1, "left", 1), (1, "left", 2), (1, "right", 9), (2, "left", 2), (2, "right", 9), (3, "left", 77)], "relation long, side string, graph_id long")
    coefficients = spark.createDataFrame([(1, 3), (2, -1), (9, 2)], "graph_id long, coefficient int").select("graph_id", F.col("coefficient").cast("decimal(20,0)").alias("coefficient"))
    found = {r["relation"]: (int(r["left_sum"]), int(r["right_sum"]), r["unknown"], r["holds"]) for r in gr.relation_residuals(relations, coefficients).collect()}
    assert found == {1: (2, 2, 0, True), 2: (-1, 2, 0, False), 3: (0, 0, 1, True)}
