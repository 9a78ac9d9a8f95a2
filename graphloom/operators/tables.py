"""Whole feature tables of graphs, vertex relabelling, and reads of positional texts: what joins the single invariants together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import rational
from graphloom.operators import invariants as inv
from graphloom.operators import structure as st
from graphloom.operators.structure import edge_lists, neighbour_masks, stacks
from graphloom.operators.wide import LOCAL, MOST_VERTICES, wide_rows
from graphloom.sources.files import materialized


def relabelled(edges: DataFrame) -> DataFrame:
    """Edges (graph_id, u, v) with vertices named 0, 1, .. in ascending order within each graph; a window holds one graph's vertices."""
    ends = inv.darts(edges).select("graph_id", F.col("src").alias("old")).distinct()
    names = ends.withColumn("new", (F.row_number().over(Window.partitionBy("graph_id").orderBy("old")) - 1).cast("int"))
    one, two = (names.select("graph_id", F.col("old").alias(c), F.col("new").alias(f"new_{c}")) for c in "uv")
    return edges.join(one, ["graph_id", "u"]).join(two, ["graph_id", "v"]).select("graph_id", F.col("new_u").alias("u"), F.col("new_v").alias("v"))


def pair_index(pairs: DataFrame, n: int) -> DataFrame:
    """(k, u, v): the pairs u < v of 0 .. n - 1 in order, numbered from 1."""
    spark = pairs.sparkSession
    u = spark.range(n).select(F.col("id").cast("int").alias("u"))
    both = u.withColumn("v", F.explode(F.sequence(F.col("u"), F.lit(n - 1)))).where("u < v")
    before = F.col("u") * (n - 1) - F.expr("u * (u - 1) div 2")
    return both.select((before + F.col("v") - F.col("u")).cast("int").alias("k"), "u", "v")


def decoded_edges(texts: DataFrame, n: int) -> DataFrame:
    """Edges of texts "{k1, k2, ..}" (graph_id, text), where k is the k-th pair of 0 .. n - 1; numbers beyond the last pair name none."""
    ks = texts.select("graph_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1))).alias("k")).select("graph_id", F.col("k").cast("int").alias("k"))
    return ks.join(F.broadcast(pair_index(texts, n)), "k").select("graph_id", "k", "u", "v")  # n * (n - 1) / 2 rows


def numerators(texts: DataFrame) -> DataFrame:
    """(graph_id, position, k): the numbers of each monomial of texts "{{k, ..}, {k, ..}}"; a monomial without numbers has one row with null."""
    blocks = texts.select("graph_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(r"\{([^{}]*)\}"), F.lit(1))).alias("position", "block"))
    return blocks.select("graph_id", "position", F.explode_outer(F.regexp_extract_all("block", F.lit(r"(\d+)"), F.lit(1))).alias("k")).select("graph_id", "position", F.col("k").cast("int").alias("k"))


def coefficients(texts: DataFrame) -> DataFrame:
    """(graph_id, position, value): the numbers of texts "{a, b/c, ..}" by position, from 0."""
    parts = F.split(F.regexp_replace("text", r"[{}\s]", ""), ",")
    return texts.select("graph_id", F.posexplode(parts).alias("position", "part")).select("graph_id", "position", rational(F.col("part")).alias("value"))


def multiplied(edges: DataFrame) -> DataFrame:
    """An edge of multiplicity k (column mult) as k rows."""
    return edges.select("graph_id", "u", "v", F.explode(F.sequence(F.lit(1), F.col("mult").cast("int"))).alias("copy"))


def padded(values: Column, width: int, fill: float = 0) -> Column:
    """An array cut or filled up to `width` values."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), width)), 1, width)


def least_rotation(values: Column, mirrored: bool = True) -> Column:
    """The least of an array's rotations, and with `mirrored` of those of its reverse."""

    def turns(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.concat(F.slice(x, i + 1, F.size(x) - i), F.slice(x, F.lit(1), i)))

    return F.array_min(F.concat(turns(values), turns(F.reverse(values))) if mirrored else turns(values))


def layer_conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """(graph_id, conflicts): edges that both layers hold, for graphs that have any."""
    return first.join(second, ["graph_id", "u", "v"], "left_semi").groupBy("graph_id").agg(F.count(F.lit(1)).alias("conflicts"))


def adjacency_rows(edges: DataFrame, n: int) -> DataFrame:
    """(graph_id, v, row): a vertex's adjacency to 0 .. n - 1 as an array of 0 and 1."""
    held = inv.darts(edges).groupBy("graph_id", F.col("src").alias("v")).agg(F.collect_set("dst").alias("near"))
    return held.select("graph_id", "v", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains("near", i).cast("int")).alias("row"))


def typed_sums(layers: dict[str, DataFrame]) -> DataFrame:
    """By vertex, the sum of its neighbours' degrees (over all layers) along the edges of each layer: (graph_id, v, sum_<layer>, ..)."""
    typed = None
    for name, edges in layers.items():
        part = inv.darts(edges).withColumn("layer", F.lit(name))
        typed = part if typed is None else typed.union(part)
    deg = typed.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("deg"))
    sums = typed.join(deg.withColumnRenamed("src", "dst"), ["graph_id", "dst"])
    return sums.groupBy("graph_id", F.col("src").alias("v")).agg(*(F.sum(F.when(F.col("layer") == n, F.col("deg")).otherwise(0)).alias(f"sum_{n}") for n in layers))


def unshared_neighbours(edges: DataFrame) -> DataFrame:
    """(graph_id, u, v, unshared): vertices that are next to one end of an edge but not to both, the ends left out."""
    near = inv.darts(edges).groupBy("graph_id", "src").agg(F.collect_set("dst").alias("near"))
    both = edges.join(near.toDF("graph_id", "u", "a"), ["graph_id", "u"]).join(near.toDF("graph_id", "v", "b"), ["graph_id", "v"])
    apart = F.array_union(F.array_except("a", "b"), F.array_except("b", "a"))
    return both.select("graph_id", "u", "v", F.size(F.array_except(apart, F.array("u", "v"))).cast("long").alias("unshared"))


def path_counts(edges: DataFrame, lengths: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(graph_id, length, paths): paths of so many edges without a repeated vertex, each once."""
    d = inv.darts(edges)
    grown = d.select("graph_id", F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    out = None
    for k in range(2, max(lengths) + 1):
        step = d.select("graph_id", F.col("src").alias("end"), F.col("dst").alias("next"))
        grown = grown.join(step, ["graph_id", "end"]).where(~F.array_contains("path", F.col("next"))).select("graph_id", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("end"))
        if k in lengths:
            part = grown.groupBy("graph_id").agg((F.count(F.lit(1)) / 2).cast("long").alias("paths")).select("graph_id", F.lit(k).alias("length"), "paths")
            out = part if out is None else out.union(part)
    return out


def largest_clique(edges: DataFrame) -> DataFrame:
    """(graph_id, largest): vertices of the largest clique. Ids to 62.

    A row is a clique with the mask of what is joined to all of it and comes after it. Rows grow by a vertex a round, row-locally, and each round is written
    before the next, until no row is left: as many rounds as the largest clique of all graphs has vertices.
    """
    masks = neighbour_masks(edges)
    rows = masks.select("graph_id", "nbr", F.posexplode("nbr").alias("v", "near")).where("near <> 0")
    rows = rows.select("graph_id", "nbr", F.lit(1).alias("k"), F.expr("near & ~(shiftleft(1L, v + 1) - 1)").alias("after"))
    sizes, k = None, 1
    while True:
        rows = materialized(rows, f"cliques-{k}")
        found = rows.groupBy("graph_id").agg(F.max("k").alias("k"))
        sizes = found if sizes is None else sizes.union(found)
        if rows.where("after <> 0").isEmpty():
            return sizes.groupBy("graph_id").agg(F.max("k").alias("largest"))
        grown = rows.where("after <> 0").select("graph_id", "nbr", "k", "after", F.explode(F.expr("filter(sequence(0, size(nbr) - 1), j -> getbit(after, j) = 1)")).alias("v"))
        rows = grown.select("graph_id", "nbr", (F.col("k") + 1).alias("k"), F.expr("after & nbr[v] & ~(shiftleft(1L, v + 1) - 1)").alias("after"))
        k += 1


def walk_traces(edges: DataFrame, most: int = 11) -> DataFrame:
    """(graph_id, walks): closed walks of 2, 3, .. `most` steps. A graph's matrix stays in one row's task, some 2 ** 21 cells at once; where vertices * largest degree ** `most` is 2 ** 63 or more, counts could leave 64 bits, and it raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, a in stacks(batches):
            bound = a.shape[1] * int(a.sum(2).max()) ** most
            if bound >= 1 << 63:
                raise OverflowError(f"walks of {most} steps may be 2 ** 63 or more")
            if bound >= 1 << 53:  # beyond what doubles hold exactly
                a = a.astype(np.int64)
            power, out = a, []
            for _ in range(2, most + 1):
                power = power @ a
                out.append(np.trace(power, axis1=1, axis2=2).astype(np.int64))
            yield pd.DataFrame({"graph_id": ids, "walks": list(np.stack(out, 1))})

    return edge_lists(edges).mapInPandas(run, "graph_id long, walks array<long>")


def cospectral_groups(edges: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Graphs on at most n vertices with equal spectra, told exactly by equal numbers of closed walks of 2 .. n steps: the size, first graph and labels of each group of two or more."""
    walks = walk_traces(edges, n).join(labels, "graph_id")
    return walks.groupBy("walks").agg(F.count(F.lit(1)).alias("graphs"), F.min("graph_id").alias("first"), F.countDistinct("y").alias("labels")).where("graphs > 1").select("first", "graphs", "labels")


def unique_graphs(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graphs, first): how many rows of `graphs` (graph_id) share an edge set, with the first of them; graphs without edges are alike."""
    sets = edges.groupBy("graph_id").agg(F.sort_array(F.collect_set(F.struct("u", "v"))).alias("edges"))
    held = graphs.join(sets, "graph_id", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<u:int,v:int>>)")))
    return held.groupBy("edges").agg(F.count(F.lit(1)).alias("graphs"), F.min("graph_id").alias("first")).select("first", "graphs")


def blocks(edges: DataFrame, size: int, parts: int) -> DataFrame:
    """The parts of each graph on vertices 0 .. `size` - 1, `size` .. 2 * `size` - 1, and so on, as graphs graph_id * `parts` + part on vertices 0 .. `size` - 1."""
    part = F.expr(f"u div {size}")
    same = edges.where(part == F.expr(f"v div {size}"))
    return same.select((F.col("graph_id") * parts + part).alias("graph_id"), (F.col("u") % size).alias("u"), (F.col("v") % size).alias("v"))


def running_totals(frame: DataFrame, by: str, value: str, width: int = 1 << 12) -> DataFrame:
    """Adds before: the sum of `value` over rows with a smaller `by` (a long). Ranges of `width` are summed alone and then moved, so no window holds all rows."""
    cut = frame.withColumn("_cut", F.expr(f"{by} div {width}")).repartition("_cut")
    sums = cut.groupBy("_cut").agg(F.sum(value).alias("_sum"))
    starts = sums.select("_cut", F.coalesce(F.sum("_sum").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_cut").orderBy(by).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_in", inside).join(starts, "_cut").withColumn("before", F.col("_start") + F.col("_in")).drop("_cut", "_in", "_start")


#: Groups of features that a user picks by name, beside those of `wide.LOCAL`; each gives one row a graph.
GROUPS: dict[str, Callable[[DataFrame], DataFrame]] = {"spectrum": st.spectral_descriptors, "centrality": lambda e: st.score_summary(st.vertex_scores(e))}
#: Presets of groups: those of one or two joins, those whose values are counts and sums, and all.
PRESETS = {"fast": ["degree", "entropy", "gini"], "counted": list(LOCAL), "full": [*LOCAL, *GROUPS]}


def graph_features(graphs: DataFrame, layers: dict[str, DataFrame], groups: str | list[str] = "full") -> DataFrame:
    """One wide row a graph: the features of the named groups on every layer, as <layer>_<feature>.

    `graphs` (graph_id, any others) gives the rows: a graph without edges in a layer has nulls there. `groups` is a preset, or names; an unknown
    name is an error. The layers become one collection of edges with the number of their layer, for `layered_features`.
    """
    stacked = None
    for k, edges in enumerate(layers.values()):
        part = edges.select("graph_id", F.lit(k).alias("layer"), "u", "v")
        stacked = part if stacked is None else stacked.union(part)
    return layered_features(graphs, stacked, list(layers), groups)


def layered_features(graphs: DataFrame, edges: DataFrame, layers: list[str], groups: str | list[str] = "full") -> DataFrame:
    """`graph_features` of edges (graph_id, layer, u, v), where layer is a layer's number; more than 62 vertices in a graph are an error.

    All edges of a graph become one row, and `wide.wide_rows` makes the features of `wide.LOCAL` of it, for all layers and groups, without another shuffle. The other groups read
    the relabelled graphs of all layers, graph_id * layers + layer, from a table that is written once, and one aggregate by graph turns rows of layers into columns.
    """
    names = PRESETS.get(groups, [groups]) if isinstance(groups, str) else list(groups)
    if unknown := [g for g in names if g not in LOCAL and g not in GROUPS]:
        raise ValueError(f"no such groups: {unknown}; there are {[*LOCAL, *GROUPS]} and the presets {list(PRESETS)}")
    lists = edges.groupBy("graph_id").agg(F.collect_list(F.struct("layer", "u", "v")).alias("edges"))
    wide = wide_rows(graphs.join(lists, "graph_id", "left"), layers, [g for g in names if g in LOCAL])
    if not (others := [g for g in names if g in GROUPS]):
        return wide
    n = len(layers)
    bound = F.when(F.col("v") < MOST_VERTICES, F.col("v")).otherwise(F.raise_error(F.lit(f"a graph has more than {MOST_VERTICES} vertices")).cast("int"))
    dense = materialized(relabelled(edges.select((F.col("graph_id") * n + F.col("layer")).alias("graph_id"), "u", "v")).withColumn("v", bound), "layers")
    held, features = dense.select("graph_id").distinct(), {g: list(LOCAL[g][1]) for g in names if g in LOCAL}
    for g in others:
        found = GROUPS[g](dense)
        features[g] = [c for c in found.columns if c != "graph_id"]
        held = held.join(found, "graph_id", "left")
    layer = F.pmod(F.col("graph_id"), F.lit(n))
    kept = [F.max(F.when(F.col("_layer") == k, F.col(c))).alias(f"{name}_{c}") for k, name in enumerate(layers) for g in others for c in features[g]]
    rest = held.withColumn("_layer", layer).withColumn("graph_id", F.expr(f"(graph_id - _layer) div {n}")).groupBy("graph_id").agg(*kept)
    return wide.join(rest, "graph_id", "left").select(*graphs.columns, *(f"{name}_{c}" for name in layers for g in names for c in features[g]))


#: Beginnings and parts of feature names by category; the first that fits counts.
CATEGORIES = [("degree", "deg_"), ("basic", "n_nodes"), ("basic", "n_edges"), ("basic", "density"), ("basic", "edges_per_node"), ("entropy", "entropy"), ("assortativity", "assortativity"), ("inequality", "gini"), ("triangles", "triangle"), ("triangles", "wedges"), ("cycles", "cycle"), ("clustering", "clustering"), ("distance", "")]


def feature_categories(names: Column) -> Column:
    """The category of a feature name: of the first of CATEGORIES whose part it holds."""
    out = F.lit(None).cast("string")
    for category, part in reversed(CATEGORIES):
        out = F.when(F.contains(names, F.lit(part)), category).otherwise(out)
    return out
