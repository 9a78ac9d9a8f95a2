"""Simple cycles up to any length, from paths that grow in the task of their graph, and what they say of vertices."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import ratio
from graphloom.operators.invariants import degrees
from graphloom.operators.structure import neighbour_masks

#: Graphs of so many vertex ids have their paths' vertices, last vertex and number in one long.
SMALL = 16
#: Graphs whose paths grow together, and paths at which they part again.
GRAPHS, PATHS = 512, 1 << 20
#: Pairs of half paths that are compared at once.
PAIRS = 1 << 20

Cycles = tuple[np.ndarray, np.ndarray, np.ndarray]  # numbers of graphs, masks of vertices, twice the cycles


def _extended(near: np.ndarray, grow: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """What `grow` makes of rows, the bits and the numbers of a vertex, for each vertex that is a bit of the row's mask `near`."""
    found, row = [], np.flatnonzero(near)
    near = near[row]
    while len(row):
        bit = near & -near
        found.append(grow(row, bit, np.bitwise_count(bit - 1).astype("int64")))
        near = near ^ bit
        left = np.flatnonzero(near)
        row, near = row[left], near[left]
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _summed(keys: tuple[np.ndarray, ...], ways: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Different keys with the sums of their ways."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, first = tuple(x[order] for x in keys), np.zeros(len(order), bool)
    first[:1] = True
    for x in keys:
        first[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(first)
    return tuple(x[starts] for x in keys), np.add.reduceat(ways[order], starts)


def _small_cycles(masks: np.ndarray, graphs: np.ndarray, longest: int) -> Iterator[list[tuple[int, Cycles]]]:
    """By length, the cycles of graphs on SMALL ids. Paths grow by a vertex at once over vertices above their first, one row for those with the same vertices and end, and close over an edge. Where paths get too many, each half of the graphs starts anew."""
    g, u = np.nonzero(masks[graphs])
    near = masks[graphs][g, u] & -(np.int64(2) << u)
    out, length = [], 2
    if near.any():
        row, bits, ends = _extended(near, lambda row, bit, v: (row, bit, v))
        key, ways = (graphs[g[row]] << 4 + SMALL) | ((np.int64(1) << u[row]) | bits) << 4 | ends, np.ones(len(row), "int64")
    while near.any():
        seen = key >> 4 & (1 << SMALL) - 1
        near, least = masks[key >> 4 + SMALL, key & 15], seen & -seen
        closed = (near & least != 0) & (length > 2)
        if closed.any():
            out.append((length, (key[closed] >> 4 + SMALL, seen[closed], ways[closed])))
        near &= ~seen & -(least << 1)
        if length == longest or not near.any():
            break
        key, ways = _extended(near, lambda row, bit, v: (key[row] & ~15 | bit << 4 | v, ways[row]))  # noqa: B023
        (key,), ways = _summed((key,), ways)
        if len(key) > PATHS and len(graphs) > 1:
            half = len(graphs) // 2
            yield from _small_cycles(masks, graphs[:half], longest)
            yield from _small_cycles(masks, graphs[half:], longest)
            return
        length += 1
    yield out


def _large_cycles(masks: np.ndarray, graph: int, longest: int) -> Iterator[tuple[int, Cycles]]:
    """The same of one graph on any ids to 62. A cycle is cut at its least vertex a and the vertex half way around: two half paths between them that share no other vertex. The half paths from one a are there at once."""
    near = masks[graph]
    for a in range(len(near)):
        above = -(np.int64(2) << np.int64(a))
        seen, x, ways = np.full(1, 1, "int64") << a, np.full(1, a), np.ones(1, "int64")
        halves = []
        for _ in range((longest + 1) // 2):
            more = near[x] & ~seen & above
            if not more.any():
                break
            seen, x, ways = _extended(more, lambda row, bit, v: (seen[row] | bit, v, ways[row]))  # noqa: B023
            (x, seen), ways = _summed((x, seen), ways)
            halves.append((x, seen, ways))
        for i, (x, seen, ways) in enumerate(halves):
            for j in (i, i + 1):
                if j == len(halves) or not 3 <= (length := i + j + 2) <= longest:
                    continue
                y, other, more = halves[j]
                low, high = np.searchsorted(y, x), np.searchsorted(y, x, side="right")
                upto = np.concatenate([[0], (high - low).cumsum()])
                start = 0
                while start < len(x):
                    end = max(start + 1, int(np.searchsorted(upto, upto[start] + PAIRS, side="right")) - 1)
                    one = np.repeat(np.arange(start, end), (high - low)[start:end])
                    two = np.arange(upto[start], upto[end]) - upto[one] + low[one]
                    met = np.bitwise_count(seen[one] & other[two]) == 2
                    one, two = one[met], two[met]
                    if len(one):
                        yield length, (np.full(len(one), graph), seen[one] | other[two], ways[one] * more[two])
                    start = end


def _cycles(masks: np.ndarray, longest: int) -> Iterator[Iterable[tuple[int, Cycles]]]:
    """All cycles of some graphs, by length, and of some others, and so on."""
    size = np.where(masks != 0, np.arange(1, masks.shape[1] + 1), 0).max(1)
    few = np.flatnonzero(size <= SMALL)
    for i in range(0, len(few), GRAPHS):
        yield from _small_cycles(masks, few[i : i + GRAPHS], longest)
    for g in np.flatnonzero(size > SMALL):
        yield _large_cycles(masks, g, longest)


def _of_cycles(edges: DataFrame, longest: int, made: Callable[[np.ndarray, Iterator[Iterable[tuple[int, Cycles]]]], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """What `made` makes, row by row with the numbers of graphs in graph_id, of the graphs' masks and their cycles by length. Only edges shuffle. Ids to 62."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists, ids = batch.column("nbr"), batch.column("graph_id").to_numpy()
            size = pc.list_value_length(lists).to_numpy()
            masks = np.zeros((len(size), size.max()), "int64")
            masks[np.arange(size.max()) < size[:, None]] = lists.flatten().to_numpy()
            for rows in made(masks, _cycles(masks, longest)):
                rows["graph_id"] = ids[rows["graph_id"]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows.values()], names=list(rows))

    return neighbour_masks(edges).where("graph_id is not null").select(F.col("graph_id").cast("long").alias("graph_id"), "nbr").mapInArrow(run, schema)


def cycle_sets(edges: DataFrame, longest: int = 11) -> DataFrame:
    """(graph_id, seen, length, cycles): simple cycles of 3 .. `longest` vertices by the mask of their vertices. Each cycle is met twice, once in either direction."""

    def summed(held: list[Cycles]) -> Cycles:
        (g, seen), ways = _summed(tuple(np.concatenate(x) for x in zip(*(c[:2] for c in held), strict=True)), np.concatenate([c[2] for c in held]))
        return g, seen, ways

    def made(masks, cycles):
        for group in cycles:
            held, waiting = [], 0
            for _, found in group:
                held.append(found)
                waiting += len(found[0])
                if waiting > PATHS:
                    held, waiting = [summed(held)], 0
            if held:
                g, seen, ways = summed(held)
                yield {"graph_id": g, "seen": seen, "length": np.bitwise_count(seen).astype("int32"), "cycles": ways // 2}

    return _of_cycles(edges, longest, made, "graph_id long, seen long, length int, cycles long")


def cycle_counts(edges: DataFrame, longest: int = 11) -> DataFrame:
    """(graph_id, length, cycles, share): simple cycles of 3 .. `longest` vertices by length, and over the number of vertex sets of that length; what `cycle_shares` says, without a row for each set."""

    def made(masks, cycles):
        counts = np.zeros((len(masks), longest + 1), "int64")
        for length, (g, _, ways) in chain.from_iterable(cycles):
            np.add.at(counts[:, length], g, ways)
        g, length = np.nonzero(counts)
        yield {"graph_id": g, "length": length.astype("int32"), "cycles": counts[g, length] // 2, "n": (masks != 0).sum(1)[g]}

    return _shares(_of_cycles(edges, longest, made, "graph_id long, length int, cycles long, n long"))


def cycle_vertices(edges: DataFrame, longest: int = 11) -> DataFrame:
    """(graph_id, v, cycles, mean_length, max_length, length_var) of the cycles of 3 .. `longest` vertices through each vertex that is on one; what `cycles_through` says, without a row for each set."""

    def made(masks, cycles):
        counts = np.zeros((longest + 1, *masks.shape), "int64")
        for length, (g, seen, ways) in chain.from_iterable(cycles):
            for v in range(masks.shape[1]):
                on = np.flatnonzero(seen >> v & 1)
                np.add.at(counts[length, :, v], g[on], ways[on])
        counts //= 2
        n, lengths = counts.sum(0), np.arange(longest + 1)
        g, v = np.nonzero(n)
        most = np.where(counts[:, g, v] > 0, lengths[:, None], 0).max(0)
        yield {"graph_id": g, "v": v.astype("int32"), "n": n[g, v], "total": lengths @ counts[:, g, v], "squares": lengths**2 @ counts[:, g, v], "max_length": most.astype("int32")}

    rows = _of_cycles(edges, longest, made, "graph_id long, v int, n long, total long, squares long, max_length int")
    n, total = F.col("n"), F.col("total")
    return rows.select("graph_id", "v", n.alias("cycles"), (total / n).alias("mean_length"), "max_length", ((n * F.col("squares") - total * total) / (n * n)).alias("length_var"))


def _shares(counts: DataFrame) -> DataFrame:
    sets_of = F.expr("aggregate(sequence(0, length - 1), 1.0D, (c, i) -> c * (n - i) / (i + 1))")
    return counts.select("graph_id", "length", "cycles", ratio(F.col("cycles"), sets_of).alias("share"))


def cycles_by_length(sets: DataFrame) -> DataFrame:
    """(graph_id, length, cycles) of `cycle_sets`."""
    return sets.groupBy("graph_id", "length").agg(F.sum("cycles").alias("cycles"))


def cycle_shares(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, length, cycles, share): cycles over the number of vertex sets of their length, C(n, length)."""
    n = degrees(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return _shares(cycles_by_length(sets).join(n, "graph_id"))


def cycles_through(sets: DataFrame) -> DataFrame:
    """(graph_id, v, cycles, mean_length, max_length, length_var) of the cycles through each vertex that is on one."""
    on = sets.select("graph_id", "length", "cycles", F.explode(F.expr("filter(sequence(0, 62), j -> getbit(seen, j) = 1)")).alias("v"))
    n, total, squares = F.sum("cycles"), F.sum(F.col("cycles") * F.col("length")), F.sum(F.col("cycles") * F.col("length") * F.col("length"))
    return on.groupBy("graph_id", "v").agg(n.alias("cycles"), (total / n).alias("mean_length"), F.max("length").alias("max_length"), ((n * squares - total * total) / (n * n)).alias("length_var"))
