"""Closed walks of many graphs at once, from powers of half their length: of stacks of matrices, or of rows of a sparse one where a graph is large."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.operators.wide import dense_ids, matrices

#: Graphs of more vertices are worked off by blocks of vertices that the walks start from.
MATRIX = 256
#: Pairs of a walk's ends that are made at once.
ENDS = 1 << 20


def flat_edges(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of its graph and the ends of every edge of rows with the lists us and vs."""
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("us")).to_numpy())
    return row, *(batch.column(c).flatten().to_numpy().astype("int64") for c in ("us", "vs"))


def _summed_products(out: np.ndarray, rough: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """`out` with the exact sums added, which 64 bits hold where the rough ones are below 2 ** 63."""
    if (out + rough >= 2.0**63).any():
        raise OverflowError("there are 2 ** 63 closed walks or more")
    return out + exact


def _small_traces(a: np.ndarray, longest: int) -> np.ndarray:
    """(graphs, longest - 1): closed walks of 2, 3, .. `longest` steps of stacked matrices."""
    most, half = int(a.sum(2).max()), (longest + 1) // 2
    if most**half >= 1 << 63:
        raise OverflowError(f"walks of {half} steps may be 2 ** 63 or more")
    if most**half >= 1 << 53:  # beyond what doubles hold exactly
        a = a.astype("int64")
    powers = [a]
    for _ in range(1, half):
        powers.append(powers[-1] @ a)
    exact = a.shape[1] * most**longest < 1 << 53
    out = np.zeros((len(a), longest - 1), "int64")
    for k in range(2, longest + 1):
        x, y = powers[k // 2 - 1], powers[k - k // 2 - 1]
        rough = np.einsum("bij,bij->b", x.astype(float), y.astype(float))
        out[:, k - 2] = rough if exact else _summed_products(out[:, k - 2], rough, np.einsum("bij,bij->b", x.astype("int64"), y.astype("int64")))
    return out


def _large_traces(u: np.ndarray, v: np.ndarray, longest: int) -> np.ndarray:
    """The same of one graph of any size: the walks of half the length from a block of its vertices, one row for those with the same ends, are there at once."""
    n, half = int(max(u.max(), v.max())) + 1, (longest + 1) // 2
    src, dst = np.concatenate([u, v]), np.concatenate([v, u])
    order = np.argsort(src, kind="stable")
    dst, deg = dst[order], np.bincount(src, minlength=n)
    starts = deg.cumsum() - deg
    if int(deg.max()) ** half >= 1 << 63:
        raise OverflowError(f"walks of {half} steps may be 2 ** 63 or more")
    out, blocks = np.zeros(longest - 1, "int64"), [(i, min(i + 1024, n)) for i in range(0, n, 1024)]
    while blocks:
        low, high = blocks.pop()
        root, end, ways, powers = np.arange(low, high), np.arange(low, high), np.ones(high - low, "int64"), []
        for _ in range(half):
            many = deg[end]
            if many.sum() > ENDS and high - low > 1:
                blocks += [(low, (low + high) // 2), ((low + high) // 2, high)]
                break
            at = np.repeat(starts[end] - (many.cumsum() - many), many) + np.arange(many.sum())
            key, ways = np.repeat(root, many) * n + dst[at], np.repeat(ways, many)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, ways = key[first], np.add.reduceat(ways[order], first)
            root, end = key // n, key % n
            powers.append((key, ways))
        else:
            for k in range(2, longest + 1):
                (x, one), (y, two) = powers[k // 2 - 1], powers[k - k // 2 - 1]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                met = y[at] == x
                one, two = one[met], two[at[met]]
                out[k - 2 : k - 1] = _summed_products(out[k - 2 : k - 1], np.array([one.astype(float) @ two.astype(float)]), np.array([one @ two]))
    return out


def traces(graph: np.ndarray, u: np.ndarray, v: np.ndarray, count: int, longest: int) -> np.ndarray:
    """(count, longest - 1): closed walks of 2, 3, .. `longest` steps of the graphs 0 .. count - 1, of edges by the numbers of their graphs."""
    out = np.zeros((count, longest - 1), "int64")
    graph, u, v = dense_ids(graph, u, v, MATRIX)
    size = np.zeros(count, "int64")
    np.maximum.at(size, graph, np.maximum(u, v) + 1)
    few = size[graph] <= MATRIX
    for at, a in matrices(graph[few], u[few], v[few]):
        out[at] = _small_traces(a, longest)
    for g in np.flatnonzero(size > MATRIX):
        low, high = np.searchsorted(graph, [g, g + 1])
        out[g] = _large_traces(u[low:high], v[low:high], longest)
    return out
