"""Graph collections, labels and predictions, read or derived as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(lines: DataFrame, *others: Column) -> DataFrame:
    s, p = (F.col(c) % 12 for c in ("l_suppkey", "l_partkey"))
    return lines.where(s != p).select(F.expr("l_orderkey div 6").alias("graph_id"), F.least(s, p).cast("int").alias("u"), F.greatest(s, p).cast("int").alias("v"), *others)


def den_edges(spark: SparkSession, sf_dir: str, by_graph: bool = False) -> DataFrame:
    """(graph_id, u, v) with u < v: six consecutive orders are a simple graph on at most 12 vertices. With `by_graph` they are dealt by graph alone: what gathers a graph's edges needs no other shuffle."""
    pairs = _pairs(table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 4 != 0))
    return (pairs.repartition("graph_id") if by_graph else pairs).distinct()


def num_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, u, v, mult): the second layer, which shares no edge with the first."""
    counted = _pairs(table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 4 == 0)).groupBy("graph_id", "u", "v").agg(F.count(F.lit(1)).alias("mult"))
    return counted.join(den_edges(spark, sf_dir), ["graph_id", "u", "v"], "left_anti")


def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, loop, y)."""
    hit = ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)).cast("int")
    return table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 6").alias("graph_id")).agg(F.max(hit).alias("y")).select("graph_id", (F.col("graph_id") % 6 + 5).cast("int").alias("loop"), "y")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, loop, y, p, p2): labels with the scores of two models, with many ties."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_linenumber").cast("int").alias("loop"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.round(F.col("l_discount").cast("double") * 10, 6).alias("p"), F.round(F.col("l_tax").cast("double") * 10, 6).alias("p2"),
    )


def parse_edge_list(text) -> DataFrame:
    """Column: "[(0, 1), (1, 2)]" as an array of (u, v) structs; null, empty or unreadable text as an empty array."""
    found = F.expr(r"regexp_extract_all(coalesce(%s, ''), '\\(\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*\\)', 0)" % text)
    number = lambda x, k: F.regexp_extract(x, r"(-?\d+)\s*,\s*(-?\d+)", k).try_cast("int")
    return F.transform(found, lambda x: F.struct(number(x, 1).alias("u"), number(x, 2).alias("v")))


def edge_list_text(edges) -> DataFrame:
    """Column: an array of (u, v) structs as "[(0, 1), (1, 2)]", in order."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(edges), lambda e: F.concat(F.lit("("), e["u"], F.lit(", "), e["v"], F.lit(")"))), ", "), F.lit("]"))
