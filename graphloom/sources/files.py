"""Graph collections and feature tables in files: readers, graph6 text, writers by row range, manifests and resumption."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.collections import parse_edge_list


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share. Where the session names none, a session on one machine takes a temporary folder, and one on a cluster raises."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        context.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialized(frame: DataFrame, label: str) -> DataFrame:
    """`frame` written to the shared folder and read back: its lineage ends there, and a lost executor loses nothing."""
    path = shared_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def file_tag() -> Column:
    """The last integer in the name of the row's file, null if it has none."""
    return F.regexp_extract(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1), r"(\d+)\D*$", 1).try_cast("int")


def read_tables(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Feature tables of several paths as one, missing columns null, with `loop` from the files' names unless a column of that name has a value."""
    options = {"header": "true", "inferSchema": "true", "mode": "PERMISSIVE"} if fmt == "csv" else {"mergeSchema": "true"}
    out = None
    for path in paths:
        frame = spark.read.options(**options).format(fmt).load(path)
        tag = F.coalesce(F.col("loop").try_cast("int"), file_tag()) if "loop" in frame.columns else file_tag()
        frame = frame.withColumn("loop", tag)
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(graph_id, coefficient) and (graph_id, layer, u, v) of CSV rows that have a graph_id and EDGES, or DEN_EDGES and NUM_EDGES."""
    frame = spark.read.csv(path, header=True)
    layers = [(c, name) for c, name in (("EDGES", "DEN"), ("DEN_EDGES", "DEN"), ("NUM_EDGES", "NUM")) if c in frame.columns]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("layer"), parse_edge_list(c).alias("edges")) for c, name in layers)))
    rows = frame.select(F.col("graph_id").try_cast("long").alias("graph_id"), each.alias("x")).select("graph_id", "x.layer", F.explode("x.edges").alias("e"))
    edges = rows.select("graph_id", "layer", F.least("e.u", "e.v").alias("u"), F.greatest("e.u", "e.v").alias("v"))
    return frame.select(F.col("graph_id").try_cast("long").alias("graph_id"), F.col("COEFFICIENTS").alias("coefficient")), edges


def graph6_text(edges: DataFrame) -> DataFrame:
    """(graph_id, graph6) of simple graphs on vertices from 0, 62 at most: six pairs to a character, by columns of the upper triangle."""
    at = (F.col("v") * (F.col("v") - 1) / 2).cast("int") + F.col("u")
    size = edges.groupBy("graph_id").agg((F.max("v") + 1).alias("n"))
    sums = edges.select("graph_id", F.floor(at / 6).cast("int").alias("k"), F.expr("shiftleft(1, 5 - (v * (v - 1) div 2 + u) % 6)").alias("x")).groupBy("graph_id", "k").agg(F.sum("x").cast("int").alias("x"))
    chars = sums.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("m")).join(size, "graph_id")
    body = "transform(sequence(0, cast(ceil(n * (n - 1) / 12) as int) - 1), k -> chr(63 + coalesce(m[k], 0)))"
    return chars.select("graph_id", F.concat(F.expr("chr(63 + n)"), F.array_join(F.expr(body), "")).alias("graph6"))


def graph6_edges(frame: DataFrame) -> DataFrame:
    """(graph_id, u, v) of (graph_id, graph6); null, empty or too short text has no edges."""
    rows = frame.where("length(graph6) > 1").withColumn("n", F.expr("ascii(graph6) - 63")).where("n between 2 and 62 and length(graph6) > ceil(n * (n - 1) / 12)")
    held = "filter(sequence(0, cast(n * (n - 1) / 2 as int) - 1), k -> shiftright(ascii(substr(graph6, 2 + cast(k div 6 as int), 1)) - 63, 5 - k % 6) & 1 = 1)"
    at = rows.select("graph_id", F.explode(F.expr(held)).alias("k")).withColumn("v", F.expr("cast(floor((1 + sqrt(1 + 8 * k)) / 2) as int)"))
    return at.select("graph_id", F.expr("cast(k - v * (v - 1) div 2 as int)").alias("u"), "v")


def with_batches(frame: DataFrame, key: str, size: int) -> DataFrame:
    """Adds batch_id: `size` consecutive keys to a batch."""
    return frame.withColumn("batch_id", F.expr(f"`{key}` div {size}"))


def write_batches(frame: DataFrame, key: str, size: int, path: str, fmt: str = "parquet") -> None:
    """A folder for each batch of keys; each batch comes from one shuffle partition, so that it has one file."""
    with_batches(frame, key, size).repartition("batch_id").write.partitionBy("batch_id").format(fmt).mode("overwrite").option("header", "true").save(path)


def manifest(frame: DataFrame, key: str, size: int) -> DataFrame:
    """(batch_id, range_start, range_end, first_key, last_key, n_rows, columns) of every batch with rows."""
    names = F.array(*(F.lit(c) for c in frame.columns))
    rows = with_batches(frame, key, size).groupBy("batch_id").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n_rows"))
    return rows.select("batch_id", (F.col("batch_id") * size).alias("range_start"), ((F.col("batch_id") + 1) * size).alias("range_end"), "first_key", "last_key", "n_rows", names.alias("columns"))


def untiled(ranges: DataFrame, start: int, end: int) -> DataFrame:
    """Rows (range_start, range_end) that don't join on to the next range, or to `start` or `end`; none if they tile [start, end) exactly.

    There is a row for each batch, not for each row of data, so one window over all of them is small.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("range_start", "range_end")
    seen = ranges.withColumn("_before", F.coalesce(F.lag("range_end").over(order), F.lit(start))).withColumn("_after", F.coalesce(F.lead("range_start").over(order), F.lit(end)))
    return seen.where((F.col("_before") != F.col("range_start")) | (F.col("_after") != F.col("range_end"))).drop("_before", "_after")


def not_done(frame: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no row of `done` has: what is left to compute."""
    return frame.join(done.select(*keys).distinct(), keys, "left_anti")
