"""Registered queries of file sources, sinks and streams, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.queries import DEN, query
from graphloom.sources import files
from graphloom.sources.collections import _pairs, den_edges, table
from graphloom.streaming.batches import run_available

#: Graphs to a batch.
BATCH = 100


@query(f"WITH {DEN}, n AS (SELECT graph_id, max(v) + 1 AS n FROM den GROUP BY 1), k AS (SELECT graph_id, n, unnest(range(CAST(ceil(n * (n - 1) / 12) AS BIGINT))) AS k FROM n), "
       "x AS (SELECT graph_id, (v * (v - 1) // 2 + u) // 6 AS k, sum(1 << (5 - (v * (v - 1) // 2 + u) % 6)) AS x FROM den GROUP BY 1, 2) "
       "SELECT graph_id, chr(CAST(63 + any_value(n) AS INT)) || string_agg(chr(CAST(63 + coalesce(x, 0) AS INT)), '' ORDER BY k) AS graph6 FROM k LEFT JOIN x USING (graph_id, k) GROUP BY 1")  # fmt: skip
def graph6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.graph6_text(den_edges(spark, sf_dir))


@query(f"WITH {DEN} SELECT graph_id, u, v FROM den")
def graph6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.graph6_edges(files.graph6_text(den_edges(spark, sf_dir)))


@query(f"WITH {DEN} SELECT graph_id // {BATCH} AS batch_id, graph_id // {BATCH} * {BATCH} AS range_start, (graph_id // {BATCH} + 1) * {BATCH} AS range_end, min(graph_id) AS first_key, max(graph_id) AS last_key, count(*) AS n_rows FROM den GROUP BY 1, 2, 3")
def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.manifest(den_edges(spark, sf_dir), "graph_id", BATCH).drop("columns")


@query(f"WITH {DEN} SELECT graph_id, u, v FROM den")
def batched_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written by row range and read again."""
    path = files.shared_path(spark, "batches")
    files.write_batches(den_edges(spark, sf_dir), "graph_id", BATCH, path)
    return spark.read.parquet(path).select("graph_id", "u", "v")


@query(f"WITH {DEN} SELECT graph_id, u, v FROM den")
def streamed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a file stream derives batch by batch; orders of one graph may come in different batches."""
    source, target = files.shared_path(spark, "stream-in"), files.shared_path(spark, "stream-out")
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber % 4 <> 0").select("l_orderkey", "l_suppkey", "l_partkey")
    lines.repartitionByRange(8, "l_orderkey").write.parquet(source)
    run_available(spark, source, lines.schema, lambda batch: _pairs(batch).distinct(), target, "l_orderkey", files=2)
    return spark.read.parquet(f"{target}/rows").select("graph_id", "u", "v").distinct()
