"""Graph invariants over an edge table (graph_id, u, v) of simple graphs, u < v: one row per graph.

Everything is keyed by graph_id, so one shuffle by that key serves a chain of joins and aggregates
(set spark.sql.requireAllClusterKeysForCoPartition to false, as `graphloom.session` does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import choose, ratio


def darts(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, (graph_id, src, dst); no shuffle."""
    both = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return edges.select("graph_id", both.alias("d")).select("graph_id", "d.src", "d.dst")


def vertex_bit(name: str) -> Column:
    """A vertex id as a bit of a long; ids beyond 62 have none and raise."""
    v = F.col(name)
    return F.when(v.between(0, 62), F.expr(f"shiftleft(1L, cast({name} as int))")).otherwise(F.raise_error(F.lit("vertex ids of 0 to 62 are needed; `relabelled` gives such")).cast("long"))


def degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, v, deg)."""
    return darts(edges).groupBy("graph_id", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """Vertices, edges, degree extremes, mean, population deviation, adjusted skewness (from exact power sums), density, edges to a vertex."""
    n, m, d = F.col("n_nodes"), F.col("n_edges"), F.col("deg")
    square, cube = n * F.col("_s2") - F.col("_s1") * F.col("_s1"), n * n * F.col("_s3") - 3 * n * F.col("_s1") * F.col("_s2") + 2 * F.col("_s1") * F.col("_s1") * F.col("_s1")
    return (
        degrees(edges).groupBy("graph_id")
        .agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("deg") / 2).cast("long").alias("n_edges"), F.min("deg").alias("deg_min"), F.max("deg").alias("deg_max"), F.avg("deg").alias("deg_avg"), F.stddev_pop("deg").alias("deg_std"), F.sum(d).alias("_s1"), F.sum(d * d).alias("_s2"), F.sum(d * d * d).alias("_s3"))
        .withColumn("_var", square.cast("double")).withColumn("deg_skew", F.when((n > 2) & (square > 0), cube.cast("double") / (F.col("_var") * F.sqrt("_var")) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2)))
        .withColumn("density", ratio(2 * m, n * (n - 1))).withColumn("edges_per_node", ratio(m, n)).drop("_s1", "_s2", "_s3", "_var")
    )


def degree_entropy(edges: DataFrame) -> DataFrame:
    """Entropy in bits of the degree distribution, and that over log2(max(n - 1, 2))."""
    counts = degrees(edges).groupBy("graph_id", "deg").agg(F.count(F.lit(1)).alias("k"))
    n = F.sum("k")
    h = F.log2(n) - F.sum(F.col("k") * F.log2("k")) / n
    return counts.groupBy("graph_id").agg(h.alias("entropy"), n.alias("n")).select("graph_id", "entropy", (F.col("entropy") / F.log2(F.greatest(F.col("n") - 1, F.lit(2)))).alias("entropy_norm"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at both ends, from exact sums; null if all degrees are equal."""
    deg, x, y = degrees(edges), F.col("a"), F.col("b")
    ends = darts(edges).join(deg.select("graph_id", F.col("v").alias("src"), F.col("deg").alias("a")), ["graph_id", "src"]).join(deg.select("graph_id", F.col("v").alias("dst"), F.col("deg").alias("b")), ["graph_id", "dst"])
    sums = ends.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.sum(x * y).alias("p"))
    return sums.select("graph_id", ratio(F.col("n") * F.col("p") - F.col("s") * F.col("s"), F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("assortativity"))


def degree_gini(edges: DataFrame) -> DataFrame:
    """Gini coefficient of the degrees."""
    w = Window.partitionBy("graph_id").orderBy("deg", "v").rowsBetween(Window.unboundedPreceding, 0)
    run = degrees(edges).withColumn("cum", F.sum("deg").over(w))
    n = F.count(F.lit(1))
    return run.groupBy("graph_id").agg(((n + 1 - 2 * F.sum("cum") / F.max("cum")) / n).alias("gini"))


def triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b, c) with a < b < c."""
    e = edges.select("graph_id", "u", "v")
    ab, ac = e.toDF("graph_id", "a", "b"), e.toDF("graph_id", "a", "c")
    return ab.join(ac, ["graph_id", "a"]).where("b < c").join(e.toDF("graph_id", "b", "c"), ["graph_id", "b", "c"], "left_semi").select("graph_id", "a", "b", "c")


def triangle_counts(edges: DataFrame) -> DataFrame:
    """Triangles, open wedges and their shares of vertex triples, for every graph with an edge."""
    base = degrees(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("deg * (deg - 1) div 2")).alias("wedges"))
    found = triangles(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("t"))
    t = F.coalesce("t", F.lit(0))
    out = base.join(found, "graph_id", "left").select("graph_id", "n", t.alias("triangles"), (F.col("wedges") - 3 * t).alias("open_wedges"))
    return out.select("graph_id", "triangles", "open_wedges", (F.col("triangles") / choose(F.col("n"), 3)).alias("triangle_share"))


def codegrees(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b, k): vertex pairs a < b with k > 0 common neighbours."""
    d = darts(edges)
    return d.toDF("graph_id", "w", "a").join(d.toDF("graph_id", "w", "b"), ["graph_id", "w"]).where("a < b").groupBy("graph_id", "a", "b").agg(F.count(F.lit(1)).alias("k"))


def four_cycles(edges: DataFrame) -> DataFrame:
    """4-cycles: half the sum over vertex pairs of the pairs of common neighbours."""
    return codegrees(edges).groupBy("graph_id").agg((F.sum(F.expr("k * (k - 1) div 2")) / 2).cast("long").alias("four_cycles"))


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """(graph_id, v1, .., vk), ascending: each step joins an edge to the last vertex and keeps what is joined to all."""
    found = edges.select("graph_id", F.col("u").alias("v1"), F.col("v").alias("v2"))
    for size in range(3, k + 1):
        found = found.join(edges.select("graph_id", F.col("u").alias("v1"), F.col("v").alias(f"v{size}")), ["graph_id", "v1"]).where(F.col(f"v{size}") > F.col(f"v{size - 1}"))
        for j in range(2, size):
            found = found.join(edges.select("graph_id", F.col("u").alias(f"v{j}"), F.col("v").alias(f"v{size}")), ["graph_id", f"v{j}", f"v{size}"], "left_semi")
    return found.select("graph_id", *(f"v{i}" for i in range(1, k + 1)))


def clique_counts(edges: DataFrame, k: int) -> DataFrame:
    return cliques(edges, k).groupBy("graph_id").agg(F.count(F.lit(1)).alias("cliques"))


def embeddedness(edges: DataFrame) -> DataFrame:
    """Common neighbours of an edge's ends: mean, deviation, shares of 0 and of 2 or more; and triangle pairs on one edge."""
    k = F.coalesce("k", F.lit(0))
    per_edge = edges.join(codegrees(edges).toDF("graph_id", "u", "v", "k"), ["graph_id", "u", "v"], "left").select("graph_id", k.alias("k"))
    return per_edge.groupBy("graph_id").agg(
        F.avg("k").alias("emb_mean"), F.stddev_pop("k").alias("emb_std"), F.avg((F.col("k") == 0).cast("double")).alias("emb_none"), F.avg((F.col("k") >= 2).cast("double")).alias("emb_two"), F.sum(F.expr("k * (k - 1) div 2")).alias("double_triangles")
    )


def local_clustering(edges: DataFrame) -> DataFrame:
    """(graph_id, v, deg, clustering): triangles at a vertex over pairs of its neighbours, 0 below degree 2."""
    corners = triangles(edges).select("graph_id", F.explode(F.array("a", "b", "c")).alias("v")).groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("t"))
    return degrees(edges).join(corners, ["graph_id", "v"], "left").select("graph_id", "v", "deg", F.coalesce(ratio(2 * F.coalesce("t", F.lit(0)), F.col("deg") * (F.col("deg") - 1)), F.lit(0.0)).alias("clustering"))


def dual_estimates(edges: DataFrame) -> DataFrame:
    """(graph_id, v, dual_degree, dual_clustering, dual_ratio, dual_betweenness, dual_share): guesses at a vertex's place in the dual graph, from its degree and triangles.

    dual_degree is triangles + degree - 2, one at least; dual_clustering is the local clustering; dual_betweenness their
    product; ratio and share are dual_degree over the degree, and over that and one.
    """
    deg, c = F.col("deg"), F.col("clustering")
    corners = F.round(c * deg * (deg - 1) / 2).cast("long")
    rows = local_clustering(edges).withColumn("dual_degree", F.greatest(corners + deg - 2, F.lit(1)))
    d = F.col("dual_degree")
    return rows.select("graph_id", "v", "dual_degree", c.alias("dual_clustering"), (d / deg).alias("dual_ratio"), (d * c).alias("dual_betweenness"), (d / (deg + 1)).alias("dual_share"))


def closed_walks(edges: DataFrame, longest: int = 5) -> DataFrame:
    """(graph_id, k, walks): traces of the adjacency matrix's powers 2 .. `longest` that are not 0. All edges of a graph meet in one task, and only they shuffle; any vertex ids will do. Counts of 2 ** 63 or more raise."""
    import numpy as np
    import pyarrow as pa

    from graphloom.operators.walks import flat_edges, traces

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            counts = traces(*flat_edges(batch), len(batch), longest)
            g, k = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(pa.array(g)), pa.array(k.astype("int32") + 2), pa.array(counts[g, k])], names=["graph_id", "k", "walks"])

    rows = edges.groupBy("graph_id").agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))
    return rows.where("graph_id is not null").mapInArrow(run, "graph_id long, k int, walks long")


def distance_summary(edges: DataFrame) -> DataFrame:
    """Components, connected or not, diameter and Wiener index (of reachable pairs), for vertex ids 0..62; larger ones raise.

    Each graph is one row of neighbour masks; balls grow row-locally, with no join a round.
    """
    rows = darts(edges).groupBy("graph_id", "src").agg(F.bit_or(vertex_bit("dst")).alias("mask")).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "mask"))).alias("nbr"))
    rows = rows.withColumn("nbr", F.expr("transform(sequence(0, array_max(map_keys(nbr))), i -> coalesce(nbr[i], 0L))"))
    grow = "transform(s.balls, b -> aggregate(sequence(0, size(nbr) - 1), b, (x, j) -> if(getbit(b, j) = 1, x | nbr[j], x)))"
    reach = "aggregate({}, 0, (x, b) -> x + bit_count(b))"
    step = f"transform(array({grow}), g -> named_struct('balls', g, 'reach', {reach.format('g')}, 'wiener', s.wiener + r * ({reach.format('g')} - s.reach), 'diameter', if({reach.format('g')} > s.reach, r, s.diameter)))[0]"
    start = "transform(nbr, (m, i) -> if(m = 0, 0L, shiftleft(1L, i)))"
    walked = f"aggregate(sequence(1, size(nbr)), named_struct('balls', {start}, 'reach', {reach.format(start)}, 'wiener', 0, 'diameter', 0), (s, r) -> if(r > 1 and s.diameter < r - 1, s, {step}))"
    out = rows.withColumn("w", F.expr(walked))
    components = F.expr("size(array_distinct(filter(w.balls, b -> b <> 0)))")
    return out.select("graph_id", components.cast("long").alias("components"), (components == 1).cast("int").alias("connected"), F.col("w.diameter").cast("long").alias("diameter"), F.expr("w.wiener div 2").alias("wiener"))


def layer_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges of either layer, of both and of any, and their Jaccard index, by graph."""
    a, b = first.select("graph_id", "u", "v").withColumn("x", F.lit(1)), second.select("graph_id", "u", "v").withColumn("y", F.lit(1))
    both = F.count(F.col("x") + F.col("y"))
    return a.join(b, ["graph_id", "u", "v"], "full_outer").groupBy("graph_id").agg(F.count("x").alias("first_edges"), F.count("y").alias("second_edges"), both.alias("common"), (both / F.count(F.lit(1))).alias("jaccard"))


def mixed_triangles(first: DataFrame, second: DataFrame) -> DataFrame:
    """Triangles of the union of two layers that have edges of both; an edge in both counts as the first layer's."""
    total = first.select("graph_id", "u", "v", F.lit(0).alias("l")).union(second.join(first, ["graph_id", "u", "v"], "left_anti").select("graph_id", "u", "v", F.lit(1).alias("l")))
    ab, ac, bc = (total.toDF("graph_id", x, y, f"l{x}{y}") for x, y in ("ab", "ac", "bc"))
    t = ab.join(ac, ["graph_id", "a"]).where("b < c").join(bc, ["graph_id", "b", "c"])
    return t.where((F.col("lab") != F.col("lac")) | (F.col("lab") != F.col("lbc"))).groupBy("graph_id").agg(F.count(F.lit(1)).alias("mixed_triangles"))


def spectral_moments(edges: DataFrame, size: int = 12) -> DataFrame:
    """(graph_id, energy, moment2, moment3, lap_gap): aggregates of the adjacency and Laplacian spectra; vertex ids 0..`size` - 1.

    Spark groups a graph's edges into one row; batches of rows become stacked matrices and one call finds all eigenvalues.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            n = len(b)
            a = np.zeros((n, size, size))
            row = np.repeat(np.arange(n), b["us"].str.len())
            u, v = np.concatenate(b["us"].to_list()), np.concatenate(b["vs"].to_list())
            a[row, u, v] = a[row, v, u] = 1
            lam = np.linalg.eigvalsh(a)
            deg = a.sum(1)
            lap = np.linalg.eigvalsh(np.eye(size) * deg[:, None, :] - a)
            absent = (deg == 0).sum(1)  # each adds a zero eigenvalue of its own
            gap = lap[np.arange(n), np.minimum(absent + 1, size - 1)]
            yield pd.DataFrame({"graph_id": b["graph_id"], "energy": np.abs(lam).sum(1), "moment2": (lam**2).sum(1), "moment3": (lam**3).sum(1), "lap_gap": gap})

    rows = edges.groupBy("graph_id").agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))
    return rows.mapInPandas(run, "graph_id long, energy double, moment2 double, moment3 double, lap_gap double")


def label_balance(labels: DataFrame) -> DataFrame:
    """Graphs by loop and label, with subtotals (null)."""
    return labels.rollup("loop", "y").agg(F.count(F.lit(1)).alias("graphs"))


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles of a table, rounded."""
    def one(name: str, kind: str) -> Column:
        return F.round(name, digits).alias(name) if kind == "double" else F.col(name)

    return frame.select(*(one(n, k) for n, k in frame.dtypes))
