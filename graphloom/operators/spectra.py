"""Eigenvectors by vertex, with signs and repeated eigenvalues taken care of, and what is made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Eigenvalues nearer than this are one eigenvalue, and components smaller than this count as zero where a sign is chosen.
SAME = 1e-7
#: Matrix cells that a Python worker stacks at once.
CELLS = 1 << 20


def _weighted_lists(edges: DataFrame) -> DataFrame:
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    return edges.groupBy("graph_id").agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"), F.collect_list(weight.cast("double")).alias("ws"))


def _decomposed(batches: Iterator[pd.DataFrame], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
    """Graph ids, vertex ids, edges (place of the graph, places of the ends, weight), eigenvalues and signed eigenvectors of rows from `_weighted_lists`, stacked by the number of vertices."""
    for batch in batches:
        names = [np.unique(np.concatenate([u, v])) for u, v in zip(batch["us"], batch["vs"], strict=True)]
        sizes = np.array([len(x) for x in names])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            step = max(1, CELLS // int(n * n))
            for part in (at[a : a + step] for a in range(0, len(at), step)):
                us, vs, ws = (batch[c].iloc[part] for c in ("us", "vs", "ws"))
                row = np.repeat(np.arange(len(part)), us.str.len())
                u, v = (np.concatenate([np.searchsorted(names[i], x) for i, x in zip(part, ends, strict=True)]) for ends in (us, vs))
                w = np.concatenate(ws.to_list())
                m = np.zeros((len(part), n, n))
                m[row, u, v] = m[row, v, u] = w
                if kind == "laplacian":
                    m = np.eye(n) * np.abs(m).sum(2)[:, :, None] - m
                value, vector = np.linalg.eigh(m)
                first = (np.abs(vector) > SAME).argmax(1)
                vector = vector * np.where(np.take_along_axis(vector, first[:, None, :], 1) < 0, -1, 1)
                yield batch["graph_id"].to_numpy()[part], np.stack([names[i] for i in part]), (row, u, v, w), value, vector


def eigenvectors(edges: DataFrame, kind: str = "laplacian") -> DataFrame:
    """(graph_id, v, k, value, component, multiplicity, weight): eigenvector k (from 0, values ascending) of each graph at each vertex with an edge.

    `edges` has graph_id, u, v and, for signed or weighted graphs, weight. `kind` is "adjacency" or "laplacian", the diagonal of which is the sum of absolute weights (the
    signed Laplacian). Vectors have length 1 and a positive first component beyond SAME. Of an eigenvalue that occurs more than once only the space is defined, not the vectors:
    `multiplicity` tells, and `weight`, the vertex's share in that space (the diagonal of its projector, over the multiplicity), depends on no basis. Any vertex ids will do.
    """
    if kind not in ("adjacency", "laplacian"):
        raise ValueError(f"no such matrix: {kind}")

    def run(batches):
        for ids, held, _, value, vector in _decomposed(batches, kind):
            group = np.cumsum(np.concatenate([np.zeros((len(ids), 1), bool), np.diff(value, axis=1) > SAME], 1), 1)
            same = group[:, :, None] == group[:, None, :]
            many = same.sum(2)
            weights = (vector**2 @ same.astype(float)) / many[:, None, :]
            g, v, k = np.indices(vector.shape).reshape(3, -1)
            yield pd.DataFrame({"graph_id": ids[g], "v": held[g, v].astype("int32"), "k": k.astype("int32"), "value": value[g, k], "component": vector[g, v, k], "multiplicity": many[g, k].astype("int32"), "weight": weights[g, v, k]})

    return _weighted_lists(edges).mapInPandas(run, "graph_id long, v int, k int, value double, component double, multiplicity int, weight double")


def extreme_vectors(vectors: DataFrame, count: int = 3) -> DataFrame:
    """(graph_id, v, low_1 .., high_1 ..): the `count` vectors of the least eigenvalues and of the largest ones at each vertex; null where the eigenvalue is repeated or the graph has fewer."""
    sizes = vectors.where("k = 0").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    x = F.when(F.col("multiplicity") == 1, F.col("component"))
    low = [F.max(F.when(F.col("k") == i, x)).alias(f"low_{i + 1}") for i in range(count)]
    high = [F.max(F.when(F.col("k") == F.col("n") - 1 - i, x)).alias(f"high_{i + 1}") for i in range(count)]
    return vectors.join(sizes, "graph_id").groupBy("graph_id", "v").agg(*low, *high)


def positions(vectors: DataFrame, count: int = 5) -> DataFrame:
    """(graph_id, v, fiedler, third, energy, encoding): the second and third Laplacian vectors at a vertex (null where repeated), the sum of squares of its shares in the first `count` eigenvalues' vectors, and the absolute
    components of the vectors 1 .. `count` as an array; a repeated eigenvalue gives the root of the vertex's weight, which no choice of basis changes."""
    size = F.when(F.col("multiplicity") == 1, F.abs("component")).otherwise(F.sqrt("weight"))
    near = vectors.where(F.col("k") <= count)
    one = lambda i: F.max(F.when((F.col("k") == i) & (F.col("multiplicity") == 1), F.col("component")))
    return near.groupBy("graph_id", "v").agg(
        one(1).alias("fiedler"), one(2).alias("third"), F.sum(F.when(F.col("k") < count, F.col("weight"))).alias("energy"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.struct("k", size.alias("x"))))), lambda r: r.x).alias("encoding"),
    )


def vertex_moments(vectors: DataFrame, most: int = 2) -> DataFrame:
    """(graph_id, v, moment_0 ..): sums over eigenvalues of value ** j times the squared component: the diagonals of the matrix's powers."""
    return vectors.groupBy("graph_id", "v").agg(*(F.sum(F.pow("value", F.lit(j)) * F.col("component") * F.col("component")).alias(f"moment_{j}") for j in range(most + 1)))


def residuals(edges: DataFrame, kind: str = "laplacian") -> DataFrame:
    """(graph_id, vectors, residual, overlap) of the vectors of `eigenvectors`: how many a graph has, the largest difference between a vector's image, summed over the edges, and its multiple, and the largest product of two different vectors (or of one with itself, less 1).

    The vectors stay in the task that finds them, so that only edges shuffle.
    """

    def run(batches):
        for ids, _, (row, u, v, w), value, vector in _decomposed(batches, kind):
            n = vector.shape[1]
            x, y, w = vector[row, u], vector[row, v], w[:, None]
            ends, parts = np.concatenate([row * n + u, row * n + v]), np.concatenate([np.abs(w) * x - w * y, np.abs(w) * y - w * x] if kind == "laplacian" else [w * y, w * x])
            order = np.argsort(ends, kind="stable")
            starts = np.flatnonzero(np.diff(ends[order], prepend=-1))
            image = np.add.reduceat(parts[order], starts).reshape(vector.shape)  # every vertex is an edge's end
            off = np.abs(image - value[:, None, :] * vector).max((1, 2))
            overlap = np.abs(vector.transpose(0, 2, 1) @ vector - np.eye(n)).max((1, 2))
            yield pd.DataFrame({"graph_id": ids, "vectors": np.full(len(ids), n), "residual": off, "overlap": overlap})

    return _weighted_lists(edges).mapInPandas(run, "graph_id long, vectors long, residual double, overlap double")


def eigenvalue_products(vectors: DataFrame) -> DataFrame:
    """(graph_id, total, zeros, log_product, sign): sum of the eigenvalues, how many are zero (within SAME), and the logarithm and sign of the product of the others."""
    x = F.col("value")
    kept = F.abs(x) > SAME
    values = vectors.groupBy("graph_id", "k").agg(F.max("value").alias("value"))
    return values.groupBy("graph_id").agg(F.sum(x).alias("total"), F.count_if(~kept).alias("zeros"), F.sum(F.when(kept, F.log(F.abs(x))).otherwise(0.0)).alias("log_product"), (1 - 2 * (F.count_if(kept & (x < 0)) % 2)).cast("int").alias("sign"))
