"""Faces of rotation systems, connectivity, communities, spreading scores and graph growth over an edge table (graph_id, u, v), u < v."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.invariants import darts, degrees
from graphloom.operators.structure import edge_lists, stacks


def ascending_rotation(edges: DataFrame) -> DataFrame:
    """(graph_id, v, pos, nbr): the cyclic order of neighbours around every vertex; here ascending."""
    order = Window.partitionBy("graph_id", "src").orderBy("dst")
    return darts(edges).select("graph_id", F.col("src").alias("v"), (F.row_number().over(order) - 1).alias("pos"), F.col("dst").alias("nbr"))


def faces(rotation: DataFrame) -> DataFrame:
    """(graph_id, src, dst, face): the darts of each face; a face is named by its least dart's place in the graph.

    After dart (a, b) comes (b, c), c following a around b. Each graph is one row of next places; the least place of an
    orbit comes by doubling the pointers, row-locally, in as many rounds as the logarithm of the number of darts.
    """
    around = Window.partitionBy("graph_id", "v").orderBy("pos")
    whole = Window.partitionBy("graph_id", "v")
    after = rotation.select("graph_id", F.col("nbr").alias("a"), F.col("v").alias("b"), F.coalesce(F.lead("nbr").over(around), F.min_by("nbr", "pos").over(whole)).alias("c"))
    rows = after.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "c"))).alias("d"))
    rows = rows.withColumn("place", F.expr("map_from_entries(transform(d, (x, i) -> struct(struct(x.a, x.b) as k, i)))"))
    rows = rows.withColumn("next", F.expr("transform(d, x -> place[struct(x.b as a, x.c as b)])")).drop("place")
    least = """aggregate(sequence(0, cast(ceil(log2(size(d))) as int)), named_struct('low', sequence(0, size(d) - 1), 'next', next),
      (s, r) -> named_struct('low', zip_with(s.low, s.next, (x, j) -> least(x, s.low[j])), 'next', transform(s.next, j -> s.next[j]))).low"""
    return rows.withColumn("low", F.expr(least)).select("graph_id", F.explode(F.arrays_zip("d", "low")).alias("x")).select("graph_id", F.col("x.d.a").alias("src"), F.col("x.d.b").alias("dst"), F.col("x.low").alias("face"))


def face_summary(rotation: DataFrame) -> DataFrame:
    """Number of faces, their mean and largest size, and how many have 3, 4 and 5 darts."""
    sizes = faces(rotation).groupBy("graph_id", "face").agg(F.count(F.lit(1)).alias("size"))
    counts = (F.count_if(F.col("size") == k).alias(f"faces_{k}") for k in (3, 4, 5))
    return sizes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_faces"), F.avg("size").alias("face_mean"), F.max("size").alias("face_max"), *counts)


def vertex_faces(rotation: DataFrame) -> DataFrame:
    """(graph_id, v, n_faces, face_mean, face_max, face_var): sizes of the different faces that meet a vertex."""
    found = faces(rotation)
    sizes = found.groupBy("graph_id", "face").agg(F.count(F.lit(1)).alias("size"))
    met = found.select("graph_id", F.col("src").alias("v"), "face").distinct().join(sizes, ["graph_id", "face"])
    return met.groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("n_faces"), F.avg("size").alias("face_mean"), F.max("size").alias("face_max"), F.var_pop("size").alias("face_var"))


def _disjoint_paths(near: list[list[int]], s: int, t: int) -> int:
    """Paths between two vertices, not next to each other, that share no other vertex: unit flows, each vertex split in an entry and an exit."""
    left = {2 * v: {2 * v + 1} for v in range(len(near))} | {2 * v + 1: {2 * w for w in ws} for v, ws in enumerate(near)}
    found = 0
    while True:
        came, queue = {2 * s + 1: -1}, [2 * s + 1]
        for x in queue:
            if x == 2 * t:
                break
            fresh = [y for y in left[x] if y not in came]
            came |= dict.fromkeys(fresh, x)
            queue += fresh
        if 2 * t not in came:
            return found
        y = 2 * t
        while came[y] >= 0:
            x = came[y]
            left[x].discard(y)
            left[y].add(x)
            y = x
        found += 1


def _vertex_connectivity(a: np.ndarray, most: int = 3) -> np.ndarray:
    """Fewest vertices whose loss parts a graph, n - 1 if none do: sets of up to `most` vertices are tried for all graphs at once, and the few graphs beyond are worked out by disjoint paths."""
    size = a.shape[1]
    if size > 63:
        raise ValueError("vertex ids of 0 to 62 are needed; `relabelled` gives such")
    bit = np.int64(1) << np.arange(size, dtype=np.int64)
    masks = (a > 0) @ bit
    present = (a.any(2) * bit).sum(1)
    found = a.any(2).sum(1) - 1
    for k in range(most, -1, -1):
        for gone in combinations(range(size), k):
            lost = np.int64(sum(1 << v for v in gone))
            left = present & ~lost
            reached = left & -left
            for _ in range(size):
                before = reached
                for j in range(size):
                    reached = reached | np.where(reached >> j & 1, masks[:, j] & left, 0)
                if (before == reached).all():
                    break
            inside = (present & lost) == lost
            found = np.where(inside & (reached != left), np.minimum(found, k), found)
    for g in np.flatnonzero(found > most):
        near = [np.flatnonzero(row).tolist() for row in a[g]]
        apart = [(s, t) for s, t in combinations(np.flatnonzero(a[g].any(1)).tolist(), 2) if t not in near[s]]
        found[g] = min([found[g], *(_disjoint_paths(near, s, t) for s, t in apart)])
    return found


def _edge_connectivity(a: np.ndarray) -> np.ndarray:
    """Smallest edge cuts: maximum-adjacency orders, the last two vertices of each merged."""
    w, active = a.copy(), a.any(2)
    row = np.arange(len(a))
    best = np.full(len(a), np.inf)
    for _ in range(a.shape[1] - 1):
        open_, pull = active.copy(), np.zeros(active.shape)
        last = before = np.zeros(len(a), int)
        for _ in range(a.shape[1]):
            some = open_.any(1)
            pick = np.where(open_, pull, -1).argmax(1)
            before, last = np.where(some, last, before), np.where(some, pick, last)
            open_[row[some], pick[some]] = False
            pull += np.where((some[:, None]) & open_, w[row, pick], 0)
        some = active.sum(1) > 1
        best[some] = np.minimum(best[some], pull[row[some], last[some]])
        g, s, t = row[some], before[some], last[some]
        w[g, s] += w[g, t]
        w[g, :, s] += w[g, :, t]
        w[g, t] = w[g, :, t] = 0
        w[g, s, s] = 0
        active[g, t] = False
    return best


def connectivity(edges: DataFrame) -> DataFrame:
    """(graph_id, vertex_connectivity, edge_connectivity); as sets of vertices are tried as masks, vertex ids go to 62."""

    def run(batches):
        for ids, a in stacks(batches):
            yield pd.DataFrame({"graph_id": ids, "vertex_connectivity": _vertex_connectivity(a).astype("int64"), "edge_connectivity": _edge_connectivity(a).astype("int64")})

    return edge_lists(edges).mapInPandas(run, "graph_id long, vertex_connectivity long, edge_connectivity long")


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(graph_id, v, community): in every round all vertices take the commonest label among themselves and their neighbours, the least of equals."""

    def run(batches):
        for ids, a in stacks(batches):
            n = a.shape[1]
            here = a.any(2)
            near = a + np.eye(n) * here[:, :, None]
            label = np.broadcast_to(np.arange(n), here.shape)
            for _ in range(rounds):
                label = (near @ (label[:, :, None] == np.arange(n))).argmax(2)
            g, v = np.nonzero(here)
            yield pd.DataFrame({"graph_id": ids[g], "v": v.astype("int32"), "community": label[g, v].astype("int32")})

    return edge_lists(edges).mapInPandas(run, "graph_id long, v int, community int")


def community_summary(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Communities, the largest one, the share of edges inside, and modularity, of any assignment (graph_id, v, community)."""
    deg = degrees(edges).join(assigned, ["graph_id", "v"]).groupBy("graph_id", "community").agg(F.sum("deg").alias("deg"), F.count(F.lit(1)).alias("size"))
    u, v = (assigned.toDF("graph_id", x, f"c{x}") for x in "uv")
    inner = edges.join(u, ["graph_id", "u"]).join(v, ["graph_id", "v"]).where("cu = cv").groupBy("graph_id", F.col("cu").alias("community")).agg(F.count(F.lit(1)).alias("inner"))
    both = deg.join(inner, ["graph_id", "community"], "left").fillna(0, ["inner"])
    sums = both.groupBy("graph_id").agg(F.count(F.lit(1)).alias("communities"), F.max("size").alias("largest"), F.sum("inner").alias("inside"), F.sum(F.col("deg") * F.col("deg")).alias("squares"), (F.sum("deg") / 2).alias("m"))
    share = F.col("inside") / F.col("m")
    return sums.select("graph_id", "communities", "largest", share.alias("inside_share"), (share - F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def spreading_scores(edges: DataFrame, alpha: float = 0.1, rounds: int = 200) -> DataFrame:
    """(graph_id, v, eigenvector, katz), each of length 1 in a graph: power iteration of A + I from equal parts, and the solution of (I - alpha A) x = 1."""

    def run(batches):
        for ids, a in stacks(batches):
            here, eye = a.any(2), np.eye(a.shape[1])
            x = here.astype(float)
            for _ in range(rounds):
                x = x + (a @ x[:, :, None])[:, :, 0]
                x /= np.sqrt((x * x).sum(1, keepdims=True))
            katz = np.linalg.solve(eye - alpha * a, here[:, :, None].astype(float))[:, :, 0]
            katz /= np.sqrt((katz * katz).sum(1, keepdims=True))
            g, v = np.nonzero(here)
            yield pd.DataFrame({"graph_id": ids[g], "v": v.astype("int32"), "eigenvector": x[g, v], "katz": katz[g, v]})

    return edge_lists(edges).mapInPandas(run, "graph_id long, v int, eigenvector double, katz double")


def neighbourhood_sums(edges: DataFrame, features: DataFrame, hops: int = 2) -> DataFrame:
    """(graph_id, v, h0, ..): a vertex feature (graph_id, v, h) and, hop after hop, its sum with those of the neighbours."""
    d, out = darts(edges), features.select("graph_id", "v", F.col("h").alias("h0"))
    for k in range(hops):
        near = d.join(out.select("graph_id", F.col("v").alias("dst"), f"h{k}"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("v")).agg(F.sum(f"h{k}").alias("_near"))
        out = out.join(near, ["graph_id", "v"], "left").withColumn(f"h{k + 1}", F.col(f"h{k}") + F.coalesce("_near", F.lit(0))).drop("_near")
    return out


def pooled(features: DataFrame) -> DataFrame:
    """Sum, mean and largest of each vertex feature, by graph."""
    names = [c for c in features.columns if c not in ("graph_id", "v")]
    return features.groupBy("graph_id").agg(*(f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.sum, "sum"), (F.avg, "mean"), (F.max, "max"))))


def double_triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, p, q, x, y): triangles pqx and pqy that share the edge (p, q), x < y."""
    d = darts(edges)
    third = edges.toDF("graph_id", "p", "q").join(d.toDF("graph_id", "p", "x"), ["graph_id", "p"]).join(d.toDF("graph_id", "q", "x"), ["graph_id", "q", "x"])
    return third.join(third.select("graph_id", "p", "q", F.col("x").alias("y")), ["graph_id", "p", "q"]).where("x < y").select("graph_id", "p", "q", "x", "y")


def merged_exponents(signed: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the sum of their exponents; an edge whose exponents cancel is gone."""
    return signed.groupBy(*keys, "u", "v").agg(F.sum("exponent").alias("exponent")).where("exponent <> 0")


def grown(edges: DataFrame) -> DataFrame:
    """(graph_id, p, q, x, y, u, v, exponent): a larger graph for every double triangle, by the rung rule.

    The new vertex, one above the largest, joins p, q, x and y with exponent -1; (p, q) and (x, y) are multiplied in with
    exponent 1. All edges of `edges` have exponent -1, so that (p, q) cancels.
    """
    top = edges.groupBy("graph_id").agg((F.max("v") + 1).alias("z"))
    keys = ["graph_id", "p", "q", "x", "y"]
    seeds = double_triangles(edges).join(top, "graph_id")
    new = F.expr("array(" + ", ".join(f"struct({c} as u, z as v, -1L as exponent)" for c in "pqxy") + ", struct(p as u, q as v, 1L as exponent), struct(x as u, y as v, 1L as exponent))")
    old = seeds.select(*keys).join(edges, "graph_id").select(*keys, "u", "v", F.lit(-1).cast("long").alias("exponent"))
    return merged_exponents(seeds.select(*keys, F.inline(new)).union(old), keys)


def contracted(signed: DataFrame, kept: int, lost: int) -> DataFrame:
    """(graph_id, u, v, exponent) with vertex `lost` drawn into `kept`: exponents of edges that meet add up, loops go."""
    to = lambda c: F.when(F.col(c) == lost, F.lit(kept)).otherwise(F.col(c))
    moved = signed.select("graph_id", to("u").alias("a"), to("v").alias("b"), "exponent").where("a <> b")
    return merged_exponents(moved.select("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "exponent"), ["graph_id"])
