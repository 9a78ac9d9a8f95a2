"""Estimates from sampled sources, pivots and vertex sets of each graph, with their errors.

What is drawn hangs on a digest of the graph, the vertex or set and a seed alone: runs repeat, and at the full rate
every estimate is the exact value. Searches keep a graph's edges and one block of sources in a task, no matrix of
all vertices, so that a graph may have far more vertices than `structure` takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.digests import ROOM, md5_of_blocks, md5_of_texts, sealed
from graphloom.functions.scalars import choose
from graphloom.operators.invariants import degrees
from graphloom.operators.structure import CELLS, _induced_sets, edge_lists, neighbour_masks


def draw(seed: int, *names: str) -> Column:
    """A digest of the named columns and the seed; rows in its order are in random order."""
    return F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in names), F.lit(str(seed))))


def sampled_sources(edges: DataFrame, sources: int, seed: int = 42) -> DataFrame:
    """(graph_id, chosen): the `sources` vertices of each graph with the least digests, all where it has fewer."""
    order = F.array_sort(F.collect_list(F.struct(draw(seed, "graph_id", "v").alias("h"), "v")))
    return degrees(edges).groupBy("graph_id").agg(F.slice(order, 1, sources)["v"].alias("chosen"))


class _Graph:
    """Edges of one graph in both directions, by their end, for searches from many roots at once."""

    def __init__(self, us: np.ndarray, vs: np.ndarray):
        self.names, dense = np.unique(np.concatenate([us, vs]), return_inverse=True)
        self.n, m = len(self.names), len(us)
        src, dst = np.concatenate([dense[:m], dense[m:]]), np.concatenate([dense[m:], dense[:m]])
        order = np.argsort(dst, kind="stable")
        self.src, self.starts = src[order], np.searchsorted(dst[order], np.arange(self.n))
        self.step = max(1, CELLS // (2 * m))

    def spread(self, x: np.ndarray) -> np.ndarray:
        """For each vertex the sum of its neighbours' values, row by row."""
        return np.add.reduceat(x[:, self.src], self.starts, axis=1)

    def searches(self, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of roots, their distances to all vertices (-1 if none) and numbers of shortest paths."""
        for i in range(0, len(roots), self.step):
            part = roots[i : i + self.step]
            paths = np.zeros((len(part), self.n))
            paths[np.arange(len(part)), part] = 1
            d, front, r = np.where(paths > 0, 0, -1), paths.copy(), 0
            while True:
                front = np.where(d < 0, self.spread(front), 0)
                if not front.any():
                    break
                r += 1
                d[front > 0] = r
                paths += front
            yield part, d, paths


def _graphs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, _Graph, np.ndarray]]:
    for batch in batches:
        for g, us, vs, chosen in zip(batch["graph_id"], batch["us"], batch["vs"], batch["chosen"], strict=True):
            graph = _Graph(np.asarray(us), np.asarray(vs))
            yield g, graph, np.searchsorted(graph.names, np.asarray(chosen))


def pivot_betweenness(edges: DataFrame, pivots: int, seed: int = 42) -> DataFrame:
    """(graph_id, v, betweenness, pivots): the shares of shortest paths from `pivots` drawn vertices that pass v, scaled by n over the pivots and by 1 / ((n - 1)(n - 2)).

    Equal to the exact betweenness of `structure.vertex_scores` where a graph has no more vertices than pivots.
    """

    def run(batches):
        for g, graph, roots in _graphs(batches):
            total = np.zeros(graph.n)
            for part, d, paths in graph.searches(roots):
                passed = np.zeros(d.shape)
                for r in range(d.max(), 0, -1):
                    passed += np.where(d == r - 1, paths * graph.spread(np.where(d == r, (1 + passed) / np.maximum(paths, 1), 0)), 0)
                passed[np.arange(len(part)), part] = 0
                total += passed.sum(0)
            scale = graph.n / len(roots) / max((graph.n - 1) * (graph.n - 2), 1)
            yield pd.DataFrame({"graph_id": g, "v": graph.names.astype("int32"), "betweenness": total * scale, "pivots": np.int32(len(roots))})

    return edge_lists(edges).join(sampled_sources(edges, pivots, seed), "graph_id").mapInPandas(run, "graph_id long, v int, betweenness double, pivots int")


def _quantile(counts: np.ndarray, q: float) -> float:
    """The interpolated quantile of the numbers 0, 1, .. that stand counts[0], counts[1], .. times."""
    place, upto = q * (counts.sum() - 1), np.cumsum(counts)
    low, high = (int(np.searchsorted(upto, x, side="right")) for x in (np.floor(place), np.ceil(place)))
    return low + (high - low) * (place - np.floor(place))


def sampled_distances(edges: DataFrame, sources: int = 200, exact_to: int = 500, seed: int = 42) -> DataFrame:
    """Distances from all vertices of connected graphs to `exact_to` vertices, and from `sources` drawn ones of the others.

    (graph_id, n_nodes, sources, effective_diameter, ecc_mean, ecc_p90, distance_mean, distance_error): the 90th
    percentile of all distances met (0 of a source to itself included), mean and 90th percentile of the sources'
    largest distances, the mean over sources of the mean distance to what they reach, and its standard error for
    sources drawn without replacement (0 from all vertices, null from one of several).
    """

    def run(batches):
        for g, graph, chosen in _graphs(batches):
            whole = graph.n <= exact_to and (next(graph.searches(np.zeros(1, int)))[1] >= 0).all()
            roots = np.arange(graph.n) if whole else chosen
            counts, far, mean = np.zeros(graph.n, "int64"), [], []
            for _, d, _ in graph.searches(roots):
                counts += np.bincount(d[d >= 0], minlength=graph.n)
                far.append(d.max(1))
                mean.append(np.where(d > 0, d, 0).sum(1) / (d > 0).sum(1))
            far, mean, k = np.concatenate(far), np.concatenate(mean), len(roots)
            error = 0.0 if k == graph.n else mean.std(ddof=1) * np.sqrt((1 - k / graph.n) / k) if k > 1 else None
            yield pd.DataFrame({"graph_id": [g], "n_nodes": [graph.n], "sources": [k], "effective_diameter": [_quantile(counts, 0.9)], "ecc_mean": [far.mean()], "ecc_p90": [np.quantile(far, 0.9)], "distance_mean": [mean.mean()], "distance_error": [error]})

    out = "graph_id long, n_nodes int, sources int, effective_diameter double, ecc_mean double, ecc_p90 double, distance_mean double, distance_error double"
    return edge_lists(edges).join(sampled_sources(edges, sources, seed), "graph_id").mapInPandas(run, out)


#: Vertex sets whose digests are made at once.
SETS = 1 << 13


@lru_cache(8)
def _classes(k: int) -> tuple[np.ndarray, list[tuple[int, str, int]]]:
    """By the bits of a set's pairs, in order, the number of its class (-1 if it is not connected), and the classes: edges, sorted degrees and triangles."""
    pairs, found, number = list(combinations(range(k), 2)), {}, []
    for code in range(1 << len(pairs)):
        edges = [p for i, p in enumerate(pairs) if code >> i & 1]
        reached, before = {0}, set()
        while reached != before:
            before = set(reached)
            reached |= {x for e in edges if before & set(e) for x in e}
        degrees = "".join(map(str, sorted(sum(v in e for e in edges) for v in range(k))))
        triangles = sum(all(p in edges for p in combinations(t, 2)) for t in combinations(range(k), 3))
        number.append(found.setdefault((len(edges), degrees, triangles), len(found)) if len(reached) == k else -1)
    return np.array(number), list(found)


def _chunks(n: int, k: int) -> Iterator[np.ndarray]:
    """The sets of `k` of n places, ascending, SETS at most at once."""
    sets = combinations(range(n), k)
    while len(part := np.fromiter(islice(sets, SETS), np.dtype((int, k)))):
        yield part


@lru_cache(256)
def _only_chunk(n: int, k: int) -> np.ndarray:
    return next(_chunks(n, k))


def _texts(sets: np.ndarray, start: int, tail: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 64 bytes with ":v1:v2.." of each set from byte `start` and `tail` after it, and where each ends; ids below 100, and no more than fit."""
    row, place = np.arange(len(sets)), np.full(len(sets), start)
    out = np.zeros((len(sets), 64), "uint8")
    for v in sets.T:
        out[row, place] = 58
        two = v >= 10
        out[row, place + 1] = 48 + np.where(two, v // 10, v)
        out[row[two], place[two] + 2] = 48 + v[two] % 10
        place = place + 2 + two
    for i, x in enumerate(tail):
        out[row, place + i] = x
    return out, place + len(tail)


@lru_cache(512)
def _blocks(mask: int, k: int, start: int, tail: bytes) -> np.ndarray:
    """Sealed texts of all sets of the vertices of `mask`, zeros where a graph's name goes; for graphs with few sets."""
    ids = np.flatnonzero(mask >> np.arange(63) & 1)
    return sealed(*_texts(ids[_only_chunk(len(ids), k)], start, tail))


def _least(digests: np.ndarray, most: int) -> np.ndarray:
    """By row, which of the digests (two numbers, rows, sets) are among the `most` least."""
    first, second = digests
    if first.shape[1] <= most:
        return np.ones(first.shape, bool)
    held = first <= np.partition(first, most - 1, 1)[:, most - 1 : most]
    for i in np.flatnonzero(held.sum(1) > most):  # first halves that are equal
        held[i] = False
        held[i, np.lexsort((second[i], first[i]))[:most]] = True
    return held


def _name_words(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(64, b"\0") for x in names), "<u4").reshape(-1, 16)


def _drawn_sets(masks: np.ndarray, names: list[bytes], k: int, most: int, tail: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of graphs and vertices of their sets of `k` vertices that have the `most` least digests. `masks` has neighbours by graph and vertex."""
    here = np.where(masks != 0, np.int64(1) << np.arange(masks.shape[1]), 0).sum(1)
    size = np.bitwise_count(here).astype(int)
    lengths = np.array([len(x) for x in names])
    room = ROOM - len(tail) - k * (2 + (masks.shape[1] > 10))
    few = (lengths <= room) & np.array([comb(int(n), k) <= SETS for n in size])
    order = np.flatnonzero(few & (size >= k))
    order = order[np.lexsort((lengths[order], here[order]))]
    ends = np.flatnonzero(np.append((np.diff(here[order]) != 0) | (np.diff(lengths[order]) != 0), True)) + 1 if len(order) else []
    held, waiting = [], 0

    def emptied() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        digests = md5_of_blocks(np.concatenate([x for _, _, x in held], 1))
        start = 0
        for at, sets, words in held:
            row, place = np.nonzero(_least(digests[:, start : start + words.shape[1]].reshape(2, len(at), -1), most))
            start += words.shape[1]
            yield at[row], sets[place]
        held.clear()

    start = 0
    for end in ends:  # graphs with the same vertices and names of the same length
        ids = np.flatnonzero(int(here[order[start]]) >> np.arange(63) & 1)
        sets = ids[_only_chunk(len(ids), k)]
        blocks = _blocks(int(here[order[start]]), k, int(lengths[order[start]]), tail)
        step = max(1, SETS // len(sets))
        for i in range(start, end, step):
            at = order[i : min(i + step, end)]
            held.append((at, sets, (blocks[:, None, :] | _name_words([names[g] for g in at]).T[:, :, None]).reshape(16, -1)))
            waiting += len(at) * len(sets)
            if waiting >= SETS:
                yield from emptied()
                waiting = 0
        start = end
    if held:
        yield from emptied()
    for g in np.flatnonzero(~few & (size >= k)):  # graphs with many sets, or with texts that no block has room for
        ids, best, digests = np.flatnonzero(masks[g]), np.empty((0, k), int), np.empty((2, 0), "uint64")
        for part in _chunks(len(ids), k):
            sets = ids[part]
            if lengths[g] <= room:
                found = md5_of_blocks(sealed(*_texts(sets, int(lengths[g]), tail)) | _name_words([names[g]]).T)
            else:
                found = md5_of_texts([names[g] + b"".join(b":%d" % v for v in x) + tail for x in sets.tolist()])
            best, digests = np.concatenate([best, sets]), np.concatenate([digests, found], 1)
            kept = _least(digests[:, None, :], most)[0]
            best, digests = best[kept], digests[:, kept]
        yield np.full(len(best), g), best


def _drawn_classes(edges: DataFrame, k: int, most: int, seed: int) -> DataFrame:
    """(graph_id, n_edges, degrees, triangles, sets, n) of the sets that `sampled_classes` draws with `most`; n is the graph's vertices. A graph's sets never leave its task, and SETS of them are there at once."""
    tail = f":{seed}".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, classes = _classes(k)
        n_edges, degrees, triangles = (np.array(x) for x in zip(*classes, strict=True))
        for batch in batches:
            lists = batch.column("nbr")
            length = pc.list_value_length(lists).to_numpy()
            if not len(length):
                continue
            masks = np.zeros((len(length), length.max()), "int64")
            masks[np.arange(length.max()) < length[:, None]] = lists.flatten().to_numpy()
            counts = np.zeros((len(length), len(classes)), "int64")
            for g, sets in _drawn_sets(masks, [x.encode() for x in batch.column("name").to_pylist()], k, most, tail):
                code = sum((masks[g, sets[:, a]] >> sets[:, b] & 1) << i for i, (a, b) in enumerate(combinations(range(k), 2)))
                kind = number[code]
                np.add.at(counts, (g[kind >= 0], kind[kind >= 0]), 1)
            g, c = np.nonzero(counts)
            n = (masks != 0).sum(1)
            columns = [batch.column("graph_id").to_numpy()[g], n_edges[c], degrees[c], triangles[c], counts[g, c], n[g]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["graph_id", "n_edges", "degrees", "triangles", "sets", "n"])

    rows = neighbour_masks(edges).where("graph_id is not null").select(F.col("graph_id").cast("long").alias("graph_id"), F.col("graph_id").cast("string").alias("name"), "nbr")
    return rows.mapInArrow(run, "graph_id long, n_edges long, degrees string, triangles long, sets long, n long")


def sampled_classes(edges: DataFrame, k: int, most: int | None = None, share: float = 1.0, seed: int = 42) -> DataFrame:
    """(graph_id, n_edges, degrees, triangles, sets, estimate, error): connected classes on `k` (4 or 5) vertices among drawn sets.

    With `most`, the sets with the `most` least digests of each graph; else each set with the chance `share`. `sets` were drawn;
    `estimate` is for all sets of the graph, `error` its standard error. All sets drawn give the counts of
    `structure.induced_classes` and no error. Classes of which no set was drawn have no row.
    """
    names = [f"v{i}" for i in range(1, k + 1)]
    h = draw(seed, "graph_id", *names)
    classes = ["graph_id", "n_edges", "degrees", "triangles"]
    if most is None:
        found = _induced_sets(edges, k, lambda rows: rows.where(h < F.lit(f"{int(share * (1 << 32)):08x}")) if share < 1 else rows).groupBy(*classes).agg(F.count(F.lit(1)).alias("sets"))
        return found.select("*", (F.col("sets") / share).alias("estimate"), (F.sqrt(F.col("sets") * (1 - share)) / share).alias("error"))
    total = choose(F.col("n"), k)
    found = _drawn_classes(edges, k, most, seed).withColumn("total", total).withColumn("drawn", F.least(total, F.lit(most)))
    p = F.col("sets") / F.col("drawn")
    return found.select(*classes, "sets", (p * F.col("total")).alias("estimate"), (F.col("total") * F.sqrt(p * (1 - p) / F.col("drawn") * (1 - F.col("drawn") / F.col("total")))).alias("error"))
