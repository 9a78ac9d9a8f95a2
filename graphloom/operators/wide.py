"""Counted features of many small graphs at once, from stacks of adjacency matrices: row-local, with no join and no shuffle.

The values are those of the operators in `invariants` and `structure` that bear the groups' names; sums of integers are exact in doubles for the graphs
that fit (62 vertices). A feature is null where its operator has no row for the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

#: Vertices of a graph: neighbours are bits of a long.
MOST_VERTICES = 62
#: Matrix cells that a Python worker stacks at once: 2 MB a matrix, of which some twenty live at a time.
CELLS = 1 << 18
#: Rows of which a Python worker makes one output batch.
ROWS = 2048

Values = tuple[np.ndarray, np.ndarray | None]  # by graph, and where they are set (None: everywhere)


def _ratio(a: np.ndarray, b: np.ndarray) -> Values:
    return a / np.where(b == 0, 1, b), b != 0


def _percentile(ordered: np.ndarray, count: np.ndarray, q: float) -> np.ndarray:
    """The interpolated quantile of the first `count` values of each row, which ascend."""
    place = q * (count - 1)
    low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
    row = np.arange(len(ordered))
    return np.where(low == high, ordered[row, low], (high - place) * ordered[row, low] + (place - low) * ordered[row, high])


class Stack:
    """Adjacency matrices of graphs with an edge each; vertices without an edge are none of theirs."""

    def __init__(self, a: np.ndarray):
        self.a, self.size = a, a.shape[1]
        self.deg = a.sum(2)
        self.here = self.deg > 0
        self.n, self.m = self.here.sum(1).astype(float), self.deg.sum(1) / 2

    @cached_property
    def two(self) -> np.ndarray:
        """Common neighbours of any two vertices; 0 on the diagonal."""
        two = self.a @ self.a
        two[:, np.arange(self.size), np.arange(self.size)] = 0
        return two

    @cached_property
    def corners(self) -> np.ndarray:
        """Triangles at each vertex."""
        return (self.two * self.a).sum(2) / 2

    @cached_property
    def clustering(self) -> np.ndarray:
        d = self.deg
        return np.where(d > 1, 2 * self.corners / np.maximum(d * (d - 1), 1), 0)

    @cached_property
    def squares(self) -> np.ndarray:
        return (self.two * (self.two - 1)).sum((1, 2)) / 8

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.nonzero(np.triu(self.a))

    @cached_property
    def masks(self) -> np.ndarray:
        return np.where(self.a > 0, np.int64(1) << np.arange(self.size), 0).sum(2)

    def by_graph(self, values: np.ndarray) -> np.ndarray:
        """Sums of values of edges."""
        return np.bincount(self.edges[0], values, len(self.a))

    @cached_property
    def distances(self) -> np.ndarray:
        """Hops between vertices of a graph, -1 where there is no way."""
        front = (np.eye(self.size) * self.here[:, :, None]).astype("float32")
        d, a, r = np.where(front > 0, 0, -1), self.a.astype("float32"), 0
        while True:
            near = (front @ a > 0) & (d < 0)
            if not near.any():
                return d
            r += 1
            d[near] = r
            front = near.astype("float32")

    @cached_property
    def components(self) -> np.ndarray:
        """Vertices that are the least of what they reach."""
        return (((self.distances >= 0).argmax(2) == np.arange(self.size)) & self.here).sum(1)

    @cached_property
    def four_cliques(self) -> np.ndarray:
        g, u, v = self.edges
        common = self.masks[g, u] & self.masks[g, v]
        inside = np.zeros(len(g), "int64")
        for j in range(self.size):
            inside += np.where(common >> j & 1, np.bitwise_count(self.masks[g, j] & common), 0)
        return self.by_graph(inside) / 12

    @cached_property
    def has_five_clique(self) -> np.ndarray:
        """Looked for where there are five 4-cliques: four joined vertices over each edge's common neighbours."""
        out = np.zeros(len(self.a), bool)
        g, u, v = self.edges
        kept = self.four_cliques[g] >= 5
        g, common = g[kept], (self.masks[g, u] & self.masks[g, v])[kept]
        for j in range(self.size):
            left = np.where(common >> j & 1, common & self.masks[g, j], 0)
            at = np.flatnonzero(np.bitwise_count(left) > 1)
            if len(at):
                for k in range(self.size):
                    joined = (left[at] >> k & 1 > 0) & (left[at] & self.masks[g[at], k] != 0)
                    out[g[at[joined]]] = True
        return out


def _degree(s: Stack) -> dict[str, Values]:
    n, m, d = s.n, s.m, s.deg
    low, high = np.where(s.here, d, np.inf).min(1), d.max(1)
    s1, s2, s3 = d.sum(1), (d**2).sum(1), (d**3).sum(1)
    square, cube = n * s2 - s1 * s1, n * n * s3 - 3 * n * s1 * s2 + 2 * s1**3
    mean, std = s1 / n, np.sqrt(square) / n
    some = (n > 2) & (square > 0)
    root = square * np.sqrt(square)
    skew = cube / np.where(some, root, 1) * np.sqrt(n * (n - 1)) / np.where(some, n - 2, 1)
    out = {"n_nodes": (n, None), "n_edges": (m, None), "deg_min": (low, None), "deg_max": (high, None), "deg_avg": (mean, None), "deg_std": (std, None), "deg_skew": (skew, some), "density": _ratio(2 * m, n * (n - 1)), "edges_per_node": _ratio(m, n)}
    return out | {f"{c}_norm": _ratio(x, n - 1) for c, x in (("deg_min", low), ("deg_max", high), ("deg_avg", mean), ("deg_std", std))}


def _entropy(s: Stack) -> dict[str, Values]:
    counts = (s.deg[:, :, None] == np.arange(1, s.size)).sum(1)
    h = np.log2(s.n) - (counts * np.log2(np.maximum(counts, 1))).sum(1) / s.n
    return {"entropy": (h, None), "entropy_norm": (h / np.log2(np.maximum(s.n - 1, 2)), None)}


def _assortativity(s: Stack) -> dict[str, Values]:
    n, total, squares = 2 * s.m, (s.deg**2).sum(1), (s.deg**3).sum(1)
    products = np.einsum("bi,bij,bj->b", s.deg, s.a, s.deg, optimize=True)
    return {"assortativity": _ratio(n * products - total**2, n * squares - total**2)}


def _gini(s: Stack) -> dict[str, Values]:
    cum = (np.sort(s.deg, 1)[:, ::-1] * np.arange(1, s.size + 1)).sum(1)
    return {"gini": ((s.n + 1 - 2 * cum / (2 * s.m)) / s.n, None)}


def _triangles(s: Stack) -> dict[str, Values]:
    t, n = s.corners.sum(1) / 3, s.n
    some = n >= 3
    return {"triangles": (t, None), "open_wedges": ((s.deg * (s.deg - 1)).sum(1) / 2 - 3 * t, None), "triangle_share": (t / np.where(some, n * (n - 1) / 2 * (n - 2) / 3, 1), some)}


def _cycles(s: Stack) -> dict[str, Values]:
    n, some = s.n, s.two.any((1, 2))
    share, whole = _ratio(s.squares * 24, n * (n - 1) * (n - 2) * (n - 3))
    return {"four_cycles": (s.squares, some), "four_cycle_share": (share, some & whole)}


def _clustering(s: Stack) -> dict[str, Values]:
    c = s.clustering
    ordered = np.sort(np.where(s.here, c, np.inf), 1)
    zero = ((c == 0) & s.here).sum(1) / s.n
    return {"clustering_mean": (c.sum(1) / s.n, None), "clustering_q50": (_percentile(ordered, s.n, 0.5), None), "clustering_q90": (_percentile(ordered, s.n, 0.9), None), "clustering_zero": (zero, None)}


def _distance(s: Stack) -> dict[str, Values]:
    d = s.distances
    return {"components": (s.components, None), "connected": (s.components == 1, None), "diameter": (d.max((1, 2)), None), "wiener": (np.maximum(d, 0).sum((1, 2)) // 2, None)}


def _embeddedness(s: Stack) -> dict[str, Values]:
    k, m = s.two[s.edges], s.m
    total, squares = s.by_graph(k), s.by_graph(k * k)
    return {"emb_mean": (total / m, None), "emb_std": (np.sqrt(m * squares - total**2) / m, None), "emb_none": (s.by_graph(k == 0) / m, None), "emb_two": (s.by_graph(k >= 2) / m, None), "double_triangles": ((squares - total) / 2, None)}


def _profile(s: Stack) -> dict[str, Values]:
    d, n, whole = s.distances, s.n, s.components == 1
    far = d.max(2)
    low, high = np.where(s.here, far, s.size).min(1), far.max(1)
    far = np.where(s.here, far, 0)
    total, squares = far.sum(1), (far**2).sum(1)
    counts = np.stack([(d == r).sum((1, 2)) for r in range(max(int(d.max()), 0) + 1)], 1)
    place, upto = 0.9 * (counts.sum(1) - 1), counts.cumsum(1)
    lower, upper = ((upto <= x[:, None]).sum(1) for x in (np.floor(place), np.ceil(place)))
    part = place - np.floor(place)
    p90 = _percentile(np.sort(np.where(s.here, far, s.size), 1), n, 0.9)
    return {
        "radius": (low, whole), "mean_distance": (np.maximum(d, 0).sum((1, 2)) / (n * (n - 1)), whole), "ecc_mean": (total / n, whole), "ecc_std": (np.sqrt(n * squares - total**2) / n, whole), "ecc_p90": (p90, whole),
        "radius_ratio": (low / high, whole), "effective_diameter": ((1 - part) * lower + part * upper, None),
    }


def _cuts(s: Stack) -> dict[str, Values]:
    masks, bit = s.masks, np.int64(1) << np.arange(s.size)
    reach = masks & -masks  # from a neighbour of each vertex, without the vertex
    while True:
        before = reach
        for j in range(s.size):
            reach = reach | np.where(reach >> j & 1, masks[:, j, None] & ~bit, 0)
        if (reach == before).all():
            break
    points = ((reach & masks) != masks).sum(1)
    g, u, v = s.edges
    reach = bit[u]  # from an edge's end, without the edge
    while True:
        before = reach
        for j in range(s.size):
            reach = reach | np.where(reach >> j & 1, masks[g, j] & ~np.where(u == j, bit[v], 0), 0)
        if (reach == before).all():
            break
    lines = s.by_graph(reach >> v & 1 == 0)
    return {"cut_points": (points, None), "bridges": (lines, None), "cut_share": (points / s.n, None), "bridge_share": (lines / s.m, None)}


def _induced(s: Stack) -> dict[str, Values]:
    """Induced classes on four vertices from the counts of not necessarily induced ones."""
    d, k, (g, u, v) = s.deg, s.two[s.edges], s.edges
    cliques = s.four_cliques
    diamond = s.by_graph(k * (k - 1) / 2) - 6 * cliques
    cycle = s.squares - diamond - 3 * cliques
    tailed = (s.corners * (d - 2)).sum(1) - 4 * diamond - 12 * cliques
    star = (d * (d - 1) * (d - 2)).sum(1) / 6 - tailed - 2 * diamond - 4 * cliques
    path = s.by_graph((d[g, u] - 1) * (d[g, v] - 1)) - s.corners.sum(1) - 4 * cycle - 2 * tailed - 6 * diamond - 12 * cliques
    out = {"path": path, "star": star, "cycle": cycle, "tailed_triangle": tailed, "diamond": diamond, "clique": cliques}
    out["connected_sets"] = sum(out.values())
    return {f"induced_{c}": (x, out["connected_sets"] > 0) for c, x in out.items()}


def _euler(s: Stack) -> dict[str, Values]:
    n, m, c = s.n, s.m, s.components
    return {"cyclomatic": (m - n + c, None), "faces": (m - n + 2, c == 1), "planar_possible": ((n < 3) | (m <= 3 * n - 6) & ~s.has_five_clique, None)}


_L, _I, _D = LongType(), IntegerType(), DoubleType()
#: By group, what makes its features of a stack, and their types.
LOCAL: dict[str, tuple[Callable[[Stack], dict[str, Values]], dict[str, object]]] = {
    "degree": (_degree, dict.fromkeys(["n_nodes", "n_edges", "deg_min", "deg_max"], _L) | dict.fromkeys(["deg_avg", "deg_std", "deg_skew", "density", "edges_per_node", "deg_min_norm", "deg_max_norm", "deg_avg_norm", "deg_std_norm"], _D)),
    "entropy": (_entropy, {"entropy": _D, "entropy_norm": _D}), "assortativity": (_assortativity, {"assortativity": _D}), "gini": (_gini, {"gini": _D}),
    "triangles": (_triangles, {"triangles": _L, "open_wedges": _L, "triangle_share": _D}), "cycles": (_cycles, {"four_cycles": _L, "four_cycle_share": _D}),
    "clustering": (_clustering, dict.fromkeys(["clustering_mean", "clustering_q50", "clustering_q90", "clustering_zero"], _D)),
    "distance": (_distance, {"components": _L, "connected": _I, "diameter": _L, "wiener": _L}),
    "embeddedness": (_embeddedness, dict.fromkeys(["emb_mean", "emb_std", "emb_none", "emb_two"], _D) | {"double_triangles": _L}),
    "profile": (_profile, {"radius": _I} | dict.fromkeys(["mean_distance", "ecc_mean", "ecc_std", "ecc_p90", "radius_ratio", "effective_diameter"], _D)),
    "cuts": (_cuts, {"cut_points": _L, "bridges": _L, "cut_share": _D, "bridge_share": _D}),
    "induced": (_induced, {f"induced_{c}": _L for c in ("path", "star", "cycle", "tailed_triangle", "diamond", "clique", "connected_sets")}),
    "euler": (_euler, {"cyclomatic": _L, "faces": _L, "planar_possible": _I}),
}


def dense_ids(graph: np.ndarray, u: np.ndarray, v: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges by graph; where vertex ids are negative, or not `below` that, vertices are named 0, 1, .. within each graph."""
    order = np.argsort(graph, kind="stable")
    graph, u, v = graph[order], u[order], v[order]
    if len(u) and (min(u.min(), v.min()) < 0 or max(u.max(), v.max()) >= below):
        ids, rank = np.unique(np.concatenate([u, v]), return_inverse=True)
        ends, at = np.unique(np.concatenate([graph, graph]) * len(ids) + rank, return_inverse=True)
        first = np.searchsorted(ends, graph * len(ids))
        u, v = at[: len(u)] - first, at[len(u) :] - first
    return graph, u, v


def matrices(graph: np.ndarray, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of graphs and their adjacency matrices, graphs of like size together, of edges from `dense_ids`."""
    if not len(graph):
        return
    starts = np.flatnonzero(np.concatenate([[True], graph[1:] != graph[:-1]]))
    size = np.maximum.reduceat(np.maximum(u, v), starts) + 1
    counts = np.diff(np.append(starts, len(graph)))
    by = np.argsort(size, kind="stable")
    rank = np.empty(len(by), int)
    rank[by] = np.arange(len(by))
    order = np.argsort(np.repeat(rank, counts), kind="stable")
    u, v = u[order], v[order]
    names, size, upto = graph[starts][by], size[by], np.concatenate([[0], counts[by].cumsum()])
    i = 0
    while i < len(names):
        j = len(names)
        while j - i > (most := max(1, CELLS // int(size[j - 1]) ** 2)):
            j = i + max(most, (j - i) // 2)
        n, at = int(size[j - 1]), np.repeat(np.arange(j - i), np.diff(upto[i : j + 1]))
        a = np.zeros((j - i, n, n))
        x, y = u[upto[i] : upto[j]], v[upto[i] : upto[j]]
        a[at, x, y] = a[at, y, x] = 1
        yield names[i:j], a
        i = j


def _stacked(graph: np.ndarray, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, Stack]]:
    """Numbers of graphs and their stacks."""
    graph, u, v = dense_ids(graph, u, v, MOST_VERTICES)
    if max(u.max(), v.max()) >= MOST_VERTICES:
        raise ValueError(f"a graph has more than {MOST_VERTICES} vertices")
    for names, a in matrices(graph, u, v):
        yield names, Stack(a)


def wide_rows(rows: DataFrame, layers: list[str], groups: list[str]) -> DataFrame:
    """`rows` (any columns, and `edges`, an array of (layer, u, v) with layers by number, or null) with the features of the groups as <layer>_<feature> in place of `edges`; null where a graph has no edge in a layer."""
    kinds = {c: kind for g in groups for c, kind in LOCAL[g][1].items()}
    made = [LOCAL[g][0] for g in groups]
    kept = [f for f in rows.schema.fields if f.name != "edges"]
    schema = StructType(kept + [StructField(f"{layer}_{c}", kind) for layer in layers for c, kind in kinds.items()])
    arrow = {c: pa.float64() if kind == _D else pa.int64() if kind == _L else pa.int32() for c, kind in kinds.items()}
    width = len(layers)

    def features(edges: pa.ListArray) -> dict[str, pa.Array]:
        size = len(edges) * width
        values, held = {c: np.zeros(size) for c in kinds}, {c: np.zeros(size, bool) for c in kinds}
        flat = edges.flatten()
        if len(flat):
            row = np.repeat(np.arange(len(edges)), pc.fill_null(pc.list_value_length(edges), 0).to_numpy(zero_copy_only=False))
            layer, u, v = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False).astype("int64") for i in range(3))
            for at, stack in _stacked(row * width + layer, u, v):
                for make in made:
                    for c, (x, some) in make(stack).items():
                        values[c][at], held[c][at] = x, True if some is None else some
        return {f"{layer}_{c}": pa.array(values[c][k::width], mask=~held[c][k::width]).cast(arrow[c]) for k, layer in enumerate(layers) for c in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch = whole.slice(start, ROWS)
                columns = {f.name: batch.column(f.name) for f in kept} | features(batch.column("edges"))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, schema)
