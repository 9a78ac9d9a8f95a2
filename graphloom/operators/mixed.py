"""Motifs that take edges from two layers: triangles, 4-cycles, diamonds and 4-cliques, all from sums of 0/1 layer marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import choose, ratio
from graphloom.operators.invariants import codegrees


def marked(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges (graph_id, u, v, l) of both layers: l is 0 for the first layer's, 1 for those that only the second has."""
    keys = ["graph_id", "u", "v"]
    both = first.select(*keys, F.lit(0).alias("l")).union(second.select(*keys, F.lit(1).alias("l")))
    return both.groupBy(*keys).agg(F.min("l").alias("l"))


def typed_edges(first: DataFrame, second: DataFrame) -> DataFrame:
    """(graph_id, src, dst, type): both directions of each edge of `marked`, with its layer's mark, as graph learners take them; no shuffle beyond that of `marked`."""
    each = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return marked(first, second).select("graph_id", F.inline(each), F.col("l").alias("type"))


def apexes(edges: DataFrame) -> DataFrame:
    """(graph_id, u, v, l, w, s): each edge with each vertex that is next to both ends; s sums the marks of the two edges there."""
    d = edges.select("graph_id", "u", "v", "l").union(edges.select("graph_id", "v", "u", "l"))
    one = edges.join(d.toDF("graph_id", "u", "w", "l1"), ["graph_id", "u"]).where("w <> v")
    return one.join(d.toDF("graph_id", "v", "w", "l2"), ["graph_id", "v", "w"]).select("graph_id", "u", "v", "l", "w", (F.col("l1") + F.col("l2")).alias("s"))


def _both(total: Column, edges: int) -> Column:
    """Whether marks that add up to `total` over so many edges are of both kinds."""
    return (total > 0) & (total < edges)


def triangle_mixture(edges: DataFrame) -> DataFrame:
    """(graph_id, triangles, mixed_triangles) of marked edges; a triangle is met on each of its edges."""
    return apexes(edges).where("w > v").groupBy("graph_id").agg(F.count(F.lit(1)).alias("triangles"), F.count_if(_both(F.col("l") + F.col("s"), 3)).alias("mixed_triangles"))


def four_cycle_mixture(edges: DataFrame) -> DataFrame:
    """(graph_id, cycles, mixed_cycles) of marked edges, from counts of two-step paths by vertex pair and marks; each cycle has two such pairs."""
    d = edges.select("graph_id", "u", "v", "l").union(edges.select("graph_id", "v", "u", "l"))
    paths = d.toDF("graph_id", "w", "a", "l1").join(d.toDF("graph_id", "w", "b", "l2"), ["graph_id", "w"]).where("a < b")
    marks = F.col("l1") + F.col("l2")
    pairs = paths.groupBy("graph_id", "a", "b").agg(F.count(F.lit(1)).alias("k"), F.count_if(marks == 0).alias("k0"), F.count_if(marks == 2).alias("k2"))
    total = F.sum(F.expr("k * (k - 1) div 2"))
    pure = F.sum(F.expr("k0 * (k0 - 1) div 2 + k2 * (k2 - 1) div 2"))
    return pairs.groupBy("graph_id").agg(F.expr("sum(k * (k - 1) div 2) div 2").alias("cycles"), ((total - pure) / 2).cast("long").alias("mixed_cycles"))


def four_set_mixture(edges: DataFrame) -> DataFrame:
    """(graph_id, diamonds, mixed_diamonds, cliques, mixed_cliques) on four vertices of marked edges.

    Two apexes of one edge make a diamond if no edge joins them, and else a clique, which is met on each of its six edges.
    """
    keys = ["graph_id", "u", "v", "l"]
    a = apexes(edges)
    wings = a.toDF(*keys, "a", "s1").join(a.toDF(*keys, "b", "s2"), keys).where("a < b")
    met = wings.join(edges.toDF("graph_id", "a", "b", "k"), ["graph_id", "a", "b"], "left").withColumn("s", F.col("l") + F.col("s1") + F.col("s2"))
    open_ = F.col("k").isNull()
    return met.groupBy("graph_id").agg(
        F.count_if(open_).alias("diamonds"), F.count_if(open_ & _both(F.col("s"), 5)).alias("mixed_diamonds"),
        (F.count("k") / 6).cast("long").alias("cliques"), (F.count_if(_both(F.col("s") + F.col("k"), 6)) / 6).cast("long").alias("mixed_cliques"),
    )


def mixed_motifs(first: DataFrame, second: DataFrame) -> DataFrame:
    """A row for each graph of either layer: motifs of both layers together, those with edges of both, their share of the motif (null if there is none) and of all vertex sets of its size (null if there are too few vertices).

    An edge in both layers counts as the first's; repeated edges count once.
    """
    edges = marked(first, second)
    out = edges.select("graph_id", F.explode(F.array("u", "v")).alias("v")).groupBy("graph_id").agg(F.count_distinct("v").alias("n"))
    kinds = {"triangles": 3, "cycles": 4, "diamonds": 4, "cliques": 4}
    for part in (triangle_mixture(edges), four_cycle_mixture(edges), four_set_mixture(edges)):
        out = out.join(part, "graph_id", "left")
    out = out.fillna(0, [f"{m}{k}" for k in kinds for m in ("", "mixed_")])
    shares = [ratio(F.col(f"mixed_{k}"), F.col(k)).alias(f"mixed_{k}_share") for k in kinds]
    sets = [ratio(F.col(f"mixed_{k}"), choose(F.col("n"), size)).alias(f"mixed_{k}_per_set") for k, size in kinds.items()]
    return out.select("*", *shares, *sets)


def square_proxy(edges: DataFrame) -> DataFrame:
    """(graph_id, square_proxy): 4 times the 4-cycles over pairs of common neighbours, null without such a pair. As every 4-cycle is two of these pairs, it is 2 wherever it is set."""
    pairs = F.sum(F.expr("k * (k - 1) div 2"))
    return codegrees(edges).groupBy("graph_id").agg(ratio(4 * pairs / 2, pairs).alias("square_proxy"))
