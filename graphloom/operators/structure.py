"""Vertex scores, robustness, induced subgraphs, cycles, colour refinement and spectra over an edge table (graph_id, u, v), u < v.

Graphs are small and many, with vertex ids from 0: each is one row of neighbour masks (ids to 62) or one matrix of a
stack. Both need one shuffle by graph_id; what follows is row-local until the last aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.invariants import clique_counts, darts, degree_summary, degrees, distance_summary, vertex_bit

#: Matrix cells that a Python worker stacks at once.
CELLS = 1 << 21
#: Vertex ids are below this where graphs become matrices.
MOST_IDS = 1 << 10


def neighbour_masks(edges: DataFrame) -> DataFrame:
    """(graph_id, nbr): by vertex id, the bits of its neighbours; 0 for ids that no edge names."""
    rows = darts(edges).groupBy("graph_id", "src").agg(F.bit_or(vertex_bit("dst")).alias("mask")).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "mask"))).alias("nbr"))
    return rows.select("graph_id", F.expr("transform(sequence(0, array_max(map_keys(nbr))), i -> coalesce(nbr[i], 0L))").alias("nbr"))


def edge_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))


def stacks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Graph ids and their adjacency matrices, stacked, of rows from `edge_lists`."""
    for batch in batches:
        if batch.empty:
            continue
        n = 1 + int(batch["vs"].map(max).max())
        if n > MOST_IDS:
            raise ValueError(f"a vertex id of {n - 1}; matrices need ids below {MOST_IDS}, as `relabelled` gives them")
        step = max(1, CELLS // (n * n))
        for i in range(0, len(batch), step):
            part = batch.iloc[i : i + step]
            a = np.zeros((len(part), n, n))
            row = np.repeat(np.arange(len(part)), part["us"].str.len())
            u, v = np.concatenate(part["us"].to_list()), np.concatenate(part["vs"].to_list())
            a[row, u, v] = a[row, v, u] = 1
            yield part["graph_id"].to_numpy(), a


def _distances(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hop distances (-1 if unreachable) and numbers of shortest paths."""
    n = a.shape[1]
    paths = np.eye(n) * a.any(2)[:, :, None]
    d = np.where(paths > 0, 0, -1)
    front = paths
    for r in range(1, n):
        front = (front @ a) * (d < 0)
        if not front.any():
            break
        d[front > 0] = r
        paths = paths + front
    return d, paths


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(graph_id, s, t, d, paths): hop distance and number of shortest paths of every reachable pair, s = t included."""

    def run(batches):
        for ids, a in stacks(batches):
            d, paths = _distances(a)
            g, s, t = np.nonzero(d >= 0)
            yield pd.DataFrame({"graph_id": ids[g], "s": s.astype("int32"), "t": t.astype("int32"), "d": d[g, s, t].astype("int32"), "paths": paths[g, s, t].astype("int64")})

    return edge_lists(edges).mapInPandas(run, "graph_id long, s int, t int, d int, paths long")


def distance_profile(edges: DataFrame) -> DataFrame:
    """Radius, mean distance, eccentricity mean, deviation and 90th percentile, radius over diameter (null unless connected), and the 90th percentile of all distances of reachable pairs, s = t included."""
    pairs = shortest_paths(edges)
    ecc = pairs.groupBy("graph_id", "s").agg(F.max("d").alias("ecc"), F.count(F.lit(1)).alias("reached"), F.sum("d").alias("far")).groupBy("graph_id").agg(
        F.min("ecc").alias("lo"), F.max("ecc").alias("hi"), F.avg("ecc").alias("mean"), F.stddev_pop("ecc").alias("sd"), F.percentile("ecc", 0.9).alias("p90"), F.count(F.lit(1)).alias("n"), F.min("reached").alias("reached"), F.sum("far").alias("far"))
    whole = lambda c: F.when(F.col("reached") == F.col("n"), c)
    n = F.col("n")
    out = ecc.select("graph_id", whole(F.col("lo")).alias("radius"), whole(F.col("far") / (n * (n - 1))).alias("mean_distance"), whole(F.col("mean")).alias("ecc_mean"), whole(F.col("sd")).alias("ecc_std"), whole(F.col("p90")).alias("ecc_p90"), whole(F.col("lo") / F.col("hi")).alias("radius_ratio"))
    return out.join(pairs.groupBy("graph_id").agg(F.percentile("d", 0.9).alias("effective_diameter")), "graph_id")


def vertex_scores(edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(graph_id, v, betweenness, closeness, harmonic, pagerank, core) of every vertex.

    Betweenness is over 2 / ((n - 1)(n - 2)), 0 below three vertices; closeness is scaled by the share of vertices
    reached; PageRank runs a fixed number of rounds from equal shares; core is the largest k whose k-core holds the vertex.
    """

    def run(batches):
        for ids, a in stacks(batches):
            d, paths = _distances(a)
            deg = a.sum(2)
            here = deg > 0
            n = here.sum(1)[:, None]
            between = np.zeros(deg.shape)
            for v in range(a.shape[1]):
                via = (d[:, :, v, None] > 0) & (d[:, v, None, :] > 0) & (d[:, :, v, None] + d[:, v, None, :] == d)
                between[:, v] = np.where(via, paths[:, :, v, None] * paths[:, v, None, :] / np.maximum(paths, 1), 0).sum((1, 2))
            reached, far = (d > 0).sum(2), np.where(d > 0, d, 0).sum(2)
            rank = here / n
            spread = a / np.maximum(deg, 1)[:, :, None]
            for _ in range(rounds):
                rank = here * ((1 - damping) / n + damping * np.einsum("bi,bij->bj", rank, spread))
            core, left, k = np.zeros(deg.shape, "int32"), here.copy(), 0
            while left.any():
                weak = left & ((a @ left[:, :, None].astype(float))[:, :, 0] <= k)
                core[weak] = k
                left &= ~weak
                k += not weak.any()
            g, v = np.nonzero(here)
            many = np.broadcast_to(n, deg.shape)
            out = {
                "betweenness": between / np.maximum((many - 1) * (many - 2), 1), "closeness": reached / np.maximum(far, 1) * reached / np.maximum(many - 1, 1),
                "harmonic": np.where(d > 0, 1 / np.maximum(d, 1), 0).sum(2), "pagerank": rank, "core": core,
            }
            yield pd.DataFrame({"graph_id": ids[g], "v": v.astype("int32")} | {c: x[g, v] for c, x in out.items()})

    return edge_lists(edges).mapInPandas(run, "graph_id long, v int, betweenness double, closeness double, harmonic double, pagerank double, core int")


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean, largest and deviation of each vertex score, by graph."""
    names = [c for c in scores.columns if c not in ("graph_id", "v")]
    return scores.groupBy("graph_id").agg(*(f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.max, "max"), (F.stddev_pop, "std"))))


def _reached(start: str, neighbours: str) -> str:
    """SQL: the mask of what `start` reaches, where vertex j has the neighbours of the SQL text `neighbours`."""
    return f"aggregate(sequence(1, size(nbr)), {start}, (b, r) -> aggregate(sequence(0, size(nbr) - 1), b, (x, j) -> if(getbit(b, j) = 1, x | {neighbours}, x)))"


def cut_counts(edges: DataFrame) -> DataFrame:
    """Articulation points and bridges, and their shares of vertices and edges: each vertex or edge is left out once, row-locally."""
    each = neighbour_masks(edges).select("graph_id", "nbr", F.posexplode("nbr").alias("v", "m")).where("m <> 0")
    parted = f"({_reached('m & -m', 'nbr[j] & ~shiftleft(1L, v)')} & m) <> m"
    points = each.groupBy("graph_id").agg(F.expr(f"count_if({parted})").alias("cut_points"), F.count(F.lit(1)).alias("n"))
    lines = each.select("graph_id", "nbr", F.col("v").alias("p"), F.explode(F.expr("filter(sequence(v, size(nbr) - 1), j -> getbit(m, j) = 1)")).alias("q"))
    without = "if(j = p, nbr[j] & ~shiftleft(1L, q), if(j = q, nbr[j] & ~shiftleft(1L, p), nbr[j]))"
    bridges = lines.groupBy("graph_id").agg(F.expr(f"count_if(getbit({_reached('shiftleft(1L, p)', without)}, q) = 0)").alias("bridges"), F.count(F.lit(1)).alias("m"))
    return points.join(bridges, "graph_id").select("graph_id", "cut_points", "bridges", (F.col("cut_points") / F.col("n")).alias("cut_share"), (F.col("bridges") / F.col("m")).alias("bridge_share"))


def _induced_sets(edges: DataFrame, k: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Of the sets that `keep` leaves of all (graph_id, nbr, v1, v2, ..): graph_id, vertices v1 < v2 < .. of each set of `k` none of which is alone in it, and their neighbours within the set as masks mv1, mv2, ..; some sets are not connected."""
    rows = neighbour_masks(edges)
    for i in range(1, k + 1):
        low = f"v{i - 1} + 1" if i > 1 else "0"
        rows = rows.withColumn(f"v{i}", F.explode(F.expr(f"if({low} > size(nbr) - {k - i + 1}, array(), sequence({low}, size(nbr) - {k - i + 1}))")))
    names = [f"v{i}" for i in range(1, k + 1)]
    rows = keep(rows).select("graph_id", F.expr(" | ".join(f"shiftleft(1L, {v})" for v in names)).alias("_set"), *(F.expr(f"nbr[{v}]").alias(f"m{v}") for v in names), *names)
    rows = rows.select("graph_id", *(F.expr(f"m{v} & _set").alias(f"m{v}") for v in names), *names)
    rows = rows.where(" and ".join(f"m{v} <> 0" for v in names))
    meets = " + ".join(f"if(getbit(m{a}, {b}) = 1, bit_count(m{a} & m{b}), 0)" for i, a in enumerate(names) for b in names[i + 1 :])
    rows = rows.withColumn("_d", F.sort_array(F.array(*(F.expr(f"bit_count(m{v})") for v in names)))).withColumn("triangles", F.expr(f"({meets}) div 3"))
    rows = rows.withColumn("n_edges", F.expr("aggregate(_d, 0, (x, y) -> x + y) div 2")).withColumn("degrees", F.array_join(F.col("_d").cast("array<string>"), ""))
    return rows.where(f"n_edges >= {k - 1} and not (n_edges = {k - 1} and triangles > 0)").drop("_d")


def induced_classes(edges: DataFrame, k: int) -> DataFrame:
    """(graph_id, n_edges, degrees, triangles, sets): connected induced subgraphs on `k` (4 or 5) vertices.

    Edges, sorted degrees and triangles tell all connected graphs of up to five vertices apart. Vertex sets come from
    row-local sequences; the counts combine before the shuffle, in which graphs already sit by graph_id.
    """
    return _induced_sets(edges, k).groupBy("graph_id", "n_edges", "degrees", "triangles").agg(F.count(F.lit(1)).alias("sets"))


def vertex_orbits(edges: DataFrame) -> DataFrame:
    """(graph_id, v, degrees, own, sets): the connected induced 4-vertex sets that hold the vertex, by their class and the vertex's degree in them, which tell all eleven orbits apart."""
    each = F.array(*(F.struct(F.col(f"v{i}").alias("v"), F.expr(f"bit_count(mv{i})").alias("own")) for i in range(1, 5)))
    return _induced_sets(edges, 4).select("graph_id", "degrees", F.inline(each)).groupBy("graph_id", "v", "degrees", "own").agg(F.count(F.lit(1)).alias("sets"))


#: Connected classes on four vertices by their sorted degrees.
FOUR = {"1122": "path", "1113": "star", "2222": "cycle", "1223": "tailed_triangle", "2233": "diamond", "3333": "clique"}


def induced_four(edges: DataFrame) -> DataFrame:
    """A column for each connected class on four vertices, and the connected sets in all."""
    found = induced_classes(edges, 4)
    return found.groupBy("graph_id").agg(*(F.sum(F.when(F.col("degrees") == d, F.col("sets")).otherwise(0)).alias(n) for d, n in FOUR.items()), F.sum("sets").alias("connected_sets"))


def simple_cycles(edges: DataFrame, longest: int = 6) -> DataFrame:
    """(graph_id, length, cycles): paths grow from their least vertex by joins on (graph_id, end) and close over an edge; each cycle is met twice."""
    d = darts(edges)
    paths = edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("last"), vertex_bit("v").alias("seen"))
    closing = edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("last"))
    out = None
    for length in range(3, longest + 1):
        paths = paths.join(d.toDF("graph_id", "last", "next"), ["graph_id", "last"]).where("next > a and getbit(seen, next) = 0").select("graph_id", "a", F.col("next").alias("last"), F.col("seen").bitwiseOR(vertex_bit("next")).alias("seen"))
        found = paths.join(closing, ["graph_id", "a", "last"], "left_semi").groupBy("graph_id").agg(F.expr("count(1) div 2").alias("cycles")).select("graph_id", F.lit(length).alias("length"), "cycles")
        out = found if out is None else out.union(found)
    return out


def cycle_membership(edges: DataFrame, longest: int = 6) -> DataFrame:
    """(graph_id, v, cycles, mean_length, max_length, length_var): simple cycles of 3 to `longest` vertices through each vertex that is on one."""
    d = darts(edges).toDF("graph_id", "last", "next")
    paths = edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("last"), F.array("u", "v").alias("seen"))
    closing = edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("last"))
    out = None
    for length in range(3, longest + 1):
        paths = paths.join(d, ["graph_id", "last"]).where("next > a and not array_contains(seen, next)").select("graph_id", "a", F.col("next").alias("last"), F.expr("concat(seen, array(next))").alias("seen"))
        met = paths.join(closing, ["graph_id", "a", "last"], "left_semi").select("graph_id", F.explode("seen").alias("v")).groupBy("graph_id", "v").agg(F.expr("count(1) div 2").alias("k")).withColumn("length", F.lit(length))
        out = met if out is None else out.union(met)
    n, total, squares = F.sum("k"), F.sum(F.col("k") * F.col("length")), F.sum(F.col("k") * F.col("length") * F.col("length"))
    return out.groupBy("graph_id", "v").agg(n.alias("cycles"), (total / n).alias("mean_length"), F.max("length").alias("max_length"), ((n * squares - total * total) / (n * n)).alias("length_var"))


def vertex_colours(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(graph_id, v, colour) after Weisfeiler-Lehman refinement from the degrees; colours compare across graphs."""
    colours = degrees(edges).select("graph_id", "v", F.md5(F.col("deg").cast("string")).alias("colour"))
    d = darts(edges)
    for _ in range(rounds):
        around = d.join(colours.toDF("graph_id", "dst", "near"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("v")).agg(F.array_join(F.sort_array(F.collect_list("near")), ",").alias("near"))
        colours = colours.join(around, ["graph_id", "v"]).select("graph_id", "v", F.md5(F.concat("colour", F.lit("|"), "near")).alias("colour"))
    return colours


def colour_summary(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Colour classes, the largest one, and a digest that isomorphic graphs share."""
    counts = vertex_colours(edges, rounds).groupBy("graph_id", "colour").agg(F.count(F.lit(1)).alias("k"))
    digest = F.md5(F.array_join(F.sort_array(F.collect_list(F.concat("colour", F.lit("x"), "k"))), ","))
    return counts.groupBy("graph_id").agg(F.count(F.lit(1)).alias("colours"), F.max("k").alias("largest"), digest.alias("digest"))


def colour_kernel_groups(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Digests that more than one graph has: how many, and the least graph_id; candidates for isomorphic duplicates."""
    return colour_summary(edges, rounds).groupBy("digest").agg(F.count(F.lit(1)).alias("graphs"), F.min("graph_id").alias("first_graph")).where("graphs > 1")


def euler_summary(edges: DataFrame) -> DataFrame:
    """Independent cycles, faces by Euler's formula (connected graphs), merges of the hop filtration, and whether m <= 3n - 6 and no 5-clique leave the graph possibly planar."""
    base = degree_summary(edges).select("graph_id", "n_nodes", "n_edges").join(distance_summary(edges).select("graph_id", "components"), "graph_id").join(clique_counts(edges, 5), "graph_id", "left")
    n, m, c = F.col("n_nodes"), F.col("n_edges"), F.col("components")
    return base.select("graph_id", (m - n + c).alias("cyclomatic"), F.when(c == 1, m - n + 2).alias("faces"), (n - c).alias("bars"), ((n < 3) | (m <= 3 * n - 6) & F.col("cliques").isNull()).cast("int").alias("planar_possible"))


def spectrum(edges: DataFrame) -> DataFrame:
    """(graph_id, kind, k, value): eigenvalues, ascending, of adjacency, Laplacian and normalised Laplacian over the vertices with an edge."""

    def run(batches):
        for ids, a in stacks(batches):
            deg = a.sum(2)
            here = deg > 0
            eye = np.eye(a.shape[1])
            lap = eye * deg[:, :, None] - a
            root = 1 / np.sqrt(np.maximum(deg, 1))
            # ids that no edge names get an eigenvalue beyond all others
            apart = eye * (~here * 1e6)[:, :, None]
            for kind, x in (("adjacency", a), ("laplacian", lap), ("normalised", lap * root[:, :, None] * root[:, None, :])):
                values = np.linalg.eigvalsh(x + apart)
                g, k = np.nonzero(np.arange(a.shape[1]) < here.sum(1)[:, None])
                yield pd.DataFrame({"graph_id": ids[g], "kind": kind, "k": k.astype("int32"), "value": values[g, k]})

    return edge_lists(edges).mapInPandas(run, "graph_id long, kind string, k int, value double")


def spectral_descriptors(edges: DataFrame, times: tuple[float, ...] = (0.1, 1.0, 5.0)) -> DataFrame:
    """Energy, Estrada index, second moments, algebraic connectivity, Kirchhoff index and heat traces: one aggregate over `spectrum`."""
    x = F.col("value")
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c))
    return spectrum(edges).groupBy("graph_id").agg(
        of("adjacency", F.abs(x)).alias("energy"), of("adjacency", F.exp(x)).alias("estrada"), of("adjacency", x * x).alias("adjacency_square"), of("laplacian", x * x).alias("laplacian_square"),
        F.max(F.when((F.col("kind") == "laplacian") & (F.col("k") == 1), F.greatest(x, F.lit(0.0)))).alias("connectivity"),
        (of("laplacian", F.lit(1)) * of("laplacian", F.when(x > 1e-9, 1 / x))).alias("kirchhoff"), *(of("laplacian", F.exp(-t * x)).alias(f"heat_{t}".replace(".", "_")) for t in times),
    )


def laplacian_prefix(edges: DataFrame, first: int = 6) -> DataFrame:
    """The `first` smallest Laplacian eigenvalues as columns lap_0, lap_1, ..; null where a graph has fewer vertices."""
    rows = spectrum(edges).where("kind = 'laplacian'")
    return rows.groupBy("graph_id").agg(*(F.max(F.when(F.col("k") == i, F.greatest("value", F.lit(0.0)))).alias(f"lap_{i}") for i in range(first)))


def heat_signature(edges: DataFrame, points: int = 32, low: float = 0.01, high: float = 100.0) -> DataFrame:
    """Heat traces of the Laplacian at `points` times on a log grid from `low` to `high`: the vector, its mean, deviation and 10th and 90th percentile."""
    times = np.geomspace(low, high, points).tolist()
    rows = spectrum(edges).where("kind = 'laplacian'")
    trace = rows.groupBy("graph_id").agg(F.array(*(F.sum(F.exp(-t * F.col("value"))) for t in times)).alias("trace"))
    each = trace.select("graph_id", F.explode("trace").alias("h")).groupBy("graph_id").agg(F.avg("h").alias("heat_mean"), F.stddev_pop("h").alias("heat_std"), F.percentile("h", 0.1).alias("heat_q10"), F.percentile("h", 0.9).alias("heat_q90"))
    return each.join(trace, "graph_id")
