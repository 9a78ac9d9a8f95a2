"""Canonical forms of graphs with coloured edges: keys that two graphs share exactly if they are isomorphic, and what is built on them.

Graphs are small and many: Spark groups a graph's edges into one row, and a task works on stacks of graphs at once. Colours of
vertices are refined until they are stable; where they don't tell all vertices apart, each vertex of the smallest class is made
single in turn, and a graph may have many such states. States whose colours are not the least of their graph go, as do states that
a symmetry of the graph carries to another state. What is left when all vertices are told apart gives an order of the vertices;
the least adjacency under these orders is the canonical form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.files import materialized

#: Odd 64-bit constants of the hash that colours are refined by. Equal hashes only leave colours coarser; forms are compared in full.
STEP, TURN, SINGLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Matrix cells of the states that a worker refines at once.
CELLS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * TURN
    return (x ^ (x >> np.uint64(27))) * SINGLE


def _classes(colour: np.ndarray) -> np.ndarray:
    """Different colours in each row."""
    ordered = np.sort(colour, 1)
    return 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(1)


def _refined(kinds: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """Rows of colours refined by the colours and edge kinds of neighbours, each row until it has no more classes than before."""
    colour = colour.copy()
    rows, had = np.arange(len(colour)), _classes(colour)
    while rows.size:
        old, own = colour[rows], kinds[rows]
        near = np.where(own > 0, _mixed(_mixed(old)[:, None, :] + own * STEP), np.uint64(0)).sum(2)
        new = _mixed(old * STEP + near)
        now = _classes(new)
        colour[rows] = new
        going = now > had[rows]
        had[rows] = now
        rows = rows[going & (now < colour.shape[1])]
    return colour


def _smallest_class(colour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of each row's smallest class of two vertices or more (of equal sizes that of the least colour), and whether there is one."""
    sizes = (colour[:, :, None] == colour[:, None, :]).sum(2)
    shared = np.where(sizes > 1, sizes, colour.shape[1] + 1)
    least = shared.min(1)
    pick = np.where(shared == least[:, None], colour, LAST).min(1)
    some = least <= colour.shape[1]
    return (colour == pick[:, None]) & some[:, None] & (shared == least[:, None]), some


def _single(colour: np.ndarray, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = colour[rows].copy()
    k = np.arange(len(rows))
    out[k, v] = _mixed(out[k, v] + SINGLE)
    return out


def _orders(kinds: np.ndarray, colour: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A way down from each state to an order of the vertices, always by the first vertex of the class: the order, and the adjacency under it."""
    colour = colour.copy()
    open_ = np.arange(len(colour))
    while open_.size:
        members, some = _smallest_class(colour[open_])
        open_, members = open_[some], members[some]
        if open_.size:
            colour[open_] = _refined(kinds[open_], _single(colour, open_, members.argmax(1)))
    order = np.argsort(colour, 1)
    return order, np.take_along_axis(np.take_along_axis(kinds, order[:, :, None], 1), order[:, None, :], 2)


def _without_images(kinds: np.ndarray, graph: np.ndarray, colour: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which states stay when those go that a symmetry carries an earlier state of the same graph to; it shows as equal adjacency under two orders."""
    keep = np.ones(len(graph), bool)
    many = np.flatnonzero(np.bincount(graph)[graph] > 1)
    if not many.size:
        return keep
    order, shape = _orders(kinds[graph[many]], colour[many], chosen[many])
    seen: dict[tuple, list[int]] = {}
    for k, i in enumerate(many):
        to = np.argsort(order[k])
        found = seen.setdefault((int(graph[i]), shape[k].tobytes()), [])
        # the symmetry takes the vertex at a place in one order to the vertex at this place in the other; it has to take chosen vertices to chosen ones
        if any((to[chosen[i]] == np.argsort(order[j])[chosen[many[j]]]).all() for j in found):
            keep[i] = False
        else:
            found.append(k)
    return keep


def canonical_stack(kinds: np.ndarray, present: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each of a stack of symmetric matrices of edge kinds (0: no edge), the vertices in canonical order and the matrix in this order.

    `present` marks the vertices that count; the others have no edges.
    """
    kinds = kinds.astype(np.uint64)
    n = kinds.shape[1]
    absent = _mixed(np.arange(1, n + 1, dtype=np.uint64) * TURN)
    first = np.where(present, np.uint64(1), absent[None, :])
    graph, colour = np.arange(len(kinds)), _refined(kinds, first)
    chosen = np.zeros((len(kinds), 0), np.int64)
    done: list[list[tuple[bytes, np.ndarray, np.ndarray]]] = [[] for _ in kinds]
    while graph.size:
        members, some = _smallest_class(colour)
        for i in np.flatnonzero(~some):
            g = graph[i]
            order = np.argsort(np.where(present[g], colour[i], LAST), kind="stable")[: present[g].sum()]
            shape = kinds[g][np.ix_(order, order)]
            done[g].append((shape.tobytes(), order, shape))
        graph, colour, members, chosen = graph[some], colour[some], members[some], chosen[some]
        if not graph.size:
            break
        # vertices with the same neighbours may be exchanged: the first of them stands for all
        own = kinds[graph]
        twins = (own[:, :, None, :] == own[:, None, :, :]).sum(3)
        same = twins >= n - 2 * (own > 0)
        first_of = (same & members[:, None, :] & members[:, :, None]).argmax(2)
        members &= first_of == np.arange(n)
        rows, v = np.nonzero(members)
        graph, chosen = graph[rows], np.hstack([chosen[rows], v[:, None]])
        step = max(1, CELLS // (n * n))
        new = _single(colour, rows, v)
        colour = np.concatenate([_refined(kinds[graph[a : a + step]], new[a : a + step]) for a in range(0, len(graph), step)])
        trace = _mixed(np.where(present[graph], _mixed(colour), np.uint64(0))).sum(1)
        least = np.full(len(kinds), LAST)
        np.minimum.at(least, graph, trace)
        keep = trace == least[graph]
        graph, colour, chosen = graph[keep], colour[keep], chosen[keep]
        keep = _without_images(kinds, graph, colour, chosen)
        graph, colour, chosen = graph[keep], colour[keep], chosen[keep]
    return [min(found, key=lambda x: x[0])[1:] if found else (np.zeros(0, np.int64), np.zeros((0, 0), np.uint64)) for found in done]


def _coloured_rows(edges: DataFrame) -> DataFrame:
    colour = F.col("colour") if "colour" in edges.columns else F.lit(1)
    return edges.groupBy("graph_id").agg(F.collect_list(F.struct("u", "v", colour.cast("long").alias("c"))).alias("e"))


_FORM = "graph_id long, vertices array<int>, edges array<struct<u:int,v:int,colour:long>>, key string"


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        names = [sorted({x for r in e for x in (r["u"], r["v"])}) for e in batch["e"]]
        sizes = np.array([len(x) for x in names])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for a in range(0, len(at), max(1, CELLS // int(n * n * n))):
                part = at[a : a + max(1, CELLS // int(n * n * n))]
                kinds, kept = np.zeros((len(part), n, n), np.int64), []
                for k, i in enumerate(part):
                    place = {x: p for p, x in enumerate(names[i])}
                    colours = sorted({r["c"] for r in batch["e"].iloc[i]})
                    kept.append(colours)
                    for r in batch["e"].iloc[i]:
                        p, q = place[r["u"]], place[r["v"]]
                        kinds[k, p, q] = kinds[k, q, p] = colours.index(r["c"]) + 1
                # the numbers of kinds are made from the colours' values, so that they mean the same in all graphs
                values = np.zeros_like(kinds)
                for k, colours in enumerate(kept):
                    table = np.array([0, *((2 * c if c > 0 else 1 - 2 * c) for c in colours)], np.int64)
                    values[k] = table[kinds[k]]
                for k, (order, shape) in enumerate(canonical_stack(values, np.ones((len(part), n), bool))):
                    i = part[k]
                    u, v = np.nonzero(np.triu(shape))
                    code = shape[u, v].astype(np.int64)
                    edges = [{"u": int(p), "v": int(q), "colour": int(c // 2 if c % 2 == 0 else (1 - c) // 2)} for p, q, c in zip(u, v, code, strict=True)]
                    key = f"{n}:" + ",".join(f"{e['u']}-{e['v']}" + (f"*{e['colour']}" if e["colour"] != 1 else "") for e in edges)
                    out.append((batch["graph_id"].iloc[i], [int(names[i][p]) for p in order], edges, key))
        yield pd.DataFrame(out, columns=["graph_id", "vertices", "edges", "key"])


def canonical_forms(edges: DataFrame) -> DataFrame:
    """(graph_id, vertices, edges, key) of every graph of `edges` (graph_id, u, v, and colour, a whole number, if edges have kinds; one row an edge).

    `vertices` are the graph's vertices in canonical order, `edges` the canonical edges (u < v from 0, with colour), and `key` their text: two graphs have
    one key exactly if a renaming of vertices turns one into the other, colours kept. Any vertex ids will do; a graph has to fit in a task.
    """
    return _coloured_rows(edges).mapInPandas(_forms, _FORM)


def canonical_edges(forms: DataFrame, *keep: str) -> DataFrame:
    """The edges of canonical forms as rows (graph_id, any of `keep`, u, v, colour)."""
    return forms.select("graph_id", *keep, F.inline("edges"))


def isomorphism_classes(edges: DataFrame) -> DataFrame:
    """(graph_id, class_id, members): the least graph_id of the graphs isomorphic to each, and how many they are.

    Edges shuffle once, by graph; keys are written once. Classes are counted before they join back, so a class with a
    third of all graphs costs a row a task, and AQE splits it in the join. (A canonical form costs a tenth of a millisecond for a graph of twelve vertices, less than refining colours by joins to find graphs that need none.)
    """
    keys = materialized(canonical_forms(edges).select("graph_id", "key"), "keys")
    sizes = keys.groupBy("key").agg(F.min("graph_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    return keys.join(sizes, "key").select("graph_id", "class_id", "members")


def looked_up(forms: DataFrame, listed: DataFrame) -> DataFrame:
    """(graph_id, position): where each canonical form stands in `listed` (position, key); null for those it doesn't hold, the first position of repeated keys."""
    first = listed.groupBy("key").agg(F.min("position").alias("position"))
    return forms.select("graph_id", "key").join(first, "key", "left").select("graph_id", "position")


def decorated(edges: DataFrame) -> DataFrame:
    """Coloured graphs as plain ones (graph_id, u, v, top): an edge of colour k >= 1 becomes a path with k + 1 vertices between its ends, numbered on from `top`, others stay.

    Where no vertex of the graph itself has degree two, two graphs are isomorphic with colours exactly if the plain ones are; `canonical_forms` needs no such care.
    """
    held = edges.groupBy("graph_id").agg((F.greatest(F.max("u"), F.max("v")) + 1).cast("long").alias("top"), F.array_sort(F.collect_list(F.struct("u", "v", F.col("colour").cast("long").alias("colour")))).alias("e"))
    size = lambda x: F.when(x.colour > 0, x.colour + 1).otherwise(F.lit(0).cast("long"))
    each = held.select("graph_id", "top", "e", F.posexplode("e").alias("i", "x"))
    before = F.aggregate(F.slice("e", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, y: a + size(y))
    first, n = F.col("top") + before, size(F.col("x"))
    inner = F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<bigint>"))
    walk = F.concat(F.array(F.col("x.u").cast("long")), inner, F.array(F.col("x.v").cast("long")))
    steps = each.select("graph_id", "top", walk.alias("w")).select("graph_id", "top", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("s"))
    return steps.select("graph_id", F.least("s.a", "s.b").alias("u"), F.greatest("s.a", "s.b").alias("v"), "top")


def undecorated(plain: DataFrame) -> DataFrame:
    """What `decorated` was made from, as (graph_id, u, v, colour), with -1 for edges that it left alone."""
    stay = plain.where("v < top").select("graph_id", "u", "v", F.lit(-1).cast("long").alias("colour"))
    inner = plain.where("v >= top")
    links = inner.where("u >= top").groupBy("graph_id").agg(F.collect_set("v").alias("later"))
    ends = inner.where("u < top").select("graph_id", "u", F.col("v").alias("p"))
    # a path's vertices are numbered on, so its first one is the largest number, up to this one, that no earlier vertex is linked to
    named = ends.join(links, "graph_id", "left").withColumn("path", F.expr("aggregate(sequence(p, 0, -1), struct(p as at, true as going), (s, j) -> if(s.going and array_contains(coalesce(later, cast(array() as array<bigint>)), j), struct(j - 1 as at, true as going), struct(s.at, false as going))).at"))
    return stay.union(named.groupBy("graph_id", "path").agg(F.min("u").alias("u"), F.max("u").alias("v"), (F.max("p") - F.min("p")).cast("long").alias("colour")).select("graph_id", "u", "v", "colour"))


def permuted(v: Column, factor: int, shift: int, n: int) -> Column:
    """Another name for vertex v of n: (factor * v + shift) % n, one to one where factor and n share no divisor."""
    return ((v * factor + shift) % n).cast("int")
