"""Colour histograms of graphs, kernels of asked pairs, and graphs as documents of colours.

Refinement is row-local on one row of neighbour masks a graph (ids to 62), so that a histogram takes one shuffle by
graph_id however many rounds it has. Kernels are computed for the pairs that a table names, never for all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.structure import neighbour_masks

#: A colour in more than one of this many graphs is looked up in a broadcast table.
COMMON = 100


def subtree_histogram(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(graph_id, round, colour, k): vertices of each colour after 0 to `rounds` refinements from the degrees; colours compare across graphs."""
    rows = neighbour_masks(edges).withColumn("c0", F.expr("transform(nbr, m -> if(m = 0, null, md5(cast(bit_count(m) as string))))"))
    for r in range(1, rounds + 1):
        near = f"array_join(array_sort(transform(filter(sequence(0, size(nbr) - 1), j -> getbit(m, j) = 1), j -> c{r - 1}[j])), ',')"
        rows = rows.withColumn(f"c{r}", F.expr(f"transform(nbr, (m, i) -> if(m = 0, null, md5(concat(c{r - 1}[i], '|', {near}))))"))
    each = rows.select("graph_id", F.posexplode(F.array(*(f"c{r}" for r in range(rounds + 1)))).alias("round", "c")).select("graph_id", "round", F.explode("c").alias("colour")).where("colour is not null")
    return each.groupBy("graph_id", "round", "colour").agg(F.count(F.lit(1)).alias("k"))


def pair_kernels(histogram: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, dot, kernel) of each distinct pair of graph ids in `pairs`: the product of both histograms, and that over the root of their own products.

    An asked pair meets the colours of its first graph by a join on graph_id, and those of its second by (graph_id,
    colour); only what both have is summed. Pairs with a graph that has no edge or id are left out; kernel is 0 where no colour is shared.
    """
    h = histogram.select("graph_id", "colour", "k")
    asked = pairs.select("a", "b").distinct()
    own = h.groupBy("graph_id").agg(F.sum(F.col("k") * F.col("k")).alias("own"))
    shared = asked.join(h.toDF("a", "colour", "ka"), "a").join(h.toDF("b", "colour", "kb"), ["b", "colour"]).groupBy("a", "b").agg(F.sum(F.col("ka") * F.col("kb")).alias("dot"))
    known = asked.join(own.toDF("a", "own_a"), "a").join(own.toDF("b", "own_b"), "b").join(shared, ["a", "b"], "left")
    dot = F.coalesce("dot", F.lit(0))
    return known.select("a", "b", dot.alias("dot"), (dot / F.sqrt(F.col("own_a").cast("double") * F.col("own_b"))).alias("kernel"))


def colour_weights(histogram: DataFrame) -> DataFrame:
    """(colour, graphs, idf): graphs that have the colour, and the log of all graphs and one over these and one."""
    graphs = histogram.agg(F.count_distinct("graph_id").alias("all"))
    found = histogram.groupBy("colour").agg(F.count(F.lit(1)).alias("graphs"))
    return found.join(F.broadcast(graphs)).select("colour", "graphs", F.ln((F.col("all") + 1) / (F.col("graphs") + 1)).alias("idf"), (F.col("graphs") * COMMON > F.col("all")).alias("common"))


def hashed_documents(histogram: DataFrame, size: int = 1024) -> DataFrame:
    """(graph_id, bucket, weight): a graph as a sparse vector of length 1 over `size` buckets; its colours are the words.

    A word adds its count times its idf to the bucket of its digest's first 32 bits, with the sign of the next hex digit.
    Graphs whose words all weigh nothing have no row. A colour stands at most once a vertex and round in a graph, so
    that at most COMMON times the words of one graph are common: those are broadcast, and no other colour has over a
    hundredth of the graphs, so that the shuffle by colour has no hot key.
    """
    weights = colour_weights(histogram)
    common, rare = weights.where("common").select("colour", "idf"), weights.where("not common").select("colour", "idf")
    looked = histogram.join(F.broadcast(common.withColumnRenamed("idf", "known")), "colour", "left")
    words = looked.where("known is not null").select("graph_id", "colour", "k", F.col("known").alias("idf")).union(looked.where("known is null").join(rare, "colour").select("graph_id", "colour", "k", "idf"))
    signed = F.when(F.conv(F.substring("colour", 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1) * F.col("k") * F.col("idf")
    bucket = (F.conv(F.substring("colour", 1, 8), 16, 10).cast("long") % size).cast("int")
    sums = words.groupBy("graph_id", bucket.alias("bucket")).agg(F.sum(signed).alias("weight")).where(F.abs("weight") > 1e-9)
    norms = sums.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return sums.join(norms, "graph_id").select("graph_id", "bucket", (F.col("weight") / F.col("norm")).alias("weight"))


def document_vectors(documents: DataFrame, size: int = 1024) -> DataFrame:
    """(graph_id, vector): the rows of `hashed_documents` as arrays of `size` numbers."""
    return documents.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m")).select("graph_id", F.expr(f"transform(sequence(0, {size - 1}), i -> coalesce(m[i], 0d))").alias("vector"))
