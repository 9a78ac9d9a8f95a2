"""Registered queries of `operators.kernels` and `operators.sampling`, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import kernels as kn
from graphloom.operators import sampling as sm
from graphloom.plans.queries import DARTS, DEG, query
from graphloom.plans.structure_queries import MASKS, PATHS, REACH, induced_sets_sql
from graphloom.sources.collections import den_edges

HISTOGRAM = f"{DEG}, wl AS (SELECT graph_id, v, md5(CAST(deg AS VARCHAR)) AS c, 0 AS i FROM deg UNION ALL SELECT a.graph_id, a.v, md5(any_value(a.c) || '|' || string_agg(b.c, ',' ORDER BY b.c)), any_value(a.i) + 1 FROM wl a JOIN darts d ON d.graph_id = a.graph_id AND d.src = a.v JOIN wl b ON b.graph_id = d.graph_id AND b.v = d.dst WHERE a.i < 3 GROUP BY 1, 2), h AS (SELECT graph_id, CAST(i AS INT) AS round, c AS colour, count(*) AS k FROM wl GROUP BY 1, 2, 3)"
SIZE = 256
PIVOTS = 4


@query(f"WITH RECURSIVE {HISTOGRAM} SELECT graph_id, round, colour, k FROM h")
def subtree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.subtree_histogram(den_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {HISTOGRAM}, own AS (SELECT graph_id, CAST(sum(k * k) AS BIGINT) AS o FROM h GROUP BY 1), p AS (SELECT a.graph_id AS a, b.graph_id AS b, CAST(a.o AS DOUBLE) * b.o AS o FROM own a JOIN own b ON b.graph_id IN (a.graph_id + 6, a.graph_id + 12)) "
       "SELECT p.a, p.b, CAST(coalesce(sum(x.k * y.k), 0) AS BIGINT) AS dot, round(CAST(coalesce(sum(x.k * y.k), 0) AS DOUBLE) / sqrt(any_value(o)), 6) AS kernel FROM p LEFT JOIN (h x JOIN h y ON x.colour = y.colour AND y.graph_id IN (x.graph_id + 6, x.graph_id + 12)) ON x.graph_id = p.a AND y.graph_id = p.b GROUP BY 1, 2")  # fmt: skip
def colour_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels of each graph with the next two of its loop."""
    edges = den_edges(spark, sf_dir)
    pairs = edges.select("graph_id").distinct().select(F.col("graph_id").alias("a"), F.explode(F.array(F.col("graph_id") + 6, F.col("graph_id") + 12)).alias("b"))
    return kn.pair_kernels(kn.subtree_histogram(edges), pairs)


@query(f"WITH RECURSIVE {HISTOGRAM}, n AS (SELECT count(DISTINCT graph_id) AS n FROM h), w AS (SELECT colour, ln((n + 1) / (count(*) + 1)) AS idf FROM h, n GROUP BY colour, n), "
       f"s AS (SELECT graph_id, CAST(CAST('0x' || substr(colour, 1, 8) AS BIGINT) % {SIZE} AS INT) AS bucket, sum(CASE WHEN substr(colour, 9, 1) < '8' THEN 1 ELSE -1 END * k * idf) AS x FROM h JOIN w USING (colour) GROUP BY 1, 2) "
       "SELECT graph_id, bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY graph_id)), 6) AS weight FROM s WHERE abs(x) > 1e-9")  # fmt: skip
def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn.hashed_documents(kn.subtree_histogram(den_edges(spark, sf_dir)), SIZE)


DRAWN = f"size AS (SELECT graph_id, count(*) AS n FROM deg GROUP BY 1), drawn AS (SELECT graph_id, v, least(n, {PIVOTS}) AS k, n FROM deg JOIN size USING (graph_id) QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY md5(graph_id || ':' || v || ':42'), v) <= {PIVOTS})"


@query(f"WITH RECURSIVE {DEG}, {DRAWN}, {PATHS}, b AS (SELECT x.graph_id, x.t AS v, sum(x.paths * y.paths / z.paths) AS b FROM drawn p JOIN sp x ON x.graph_id = p.graph_id AND x.s = p.v JOIN sp y ON y.graph_id = x.graph_id AND y.s = x.t AND x.d > 0 AND y.d > 0 JOIN sp z ON z.graph_id = x.graph_id AND z.s = x.s AND z.t = y.t AND z.d = x.d + y.d GROUP BY 1, 2) "
       "SELECT deg.graph_id, deg.v, round(coalesce(b, 0) * n / k / greatest((n - 1) * (n - 2), 1), 6) AS betweenness, CAST(k AS INT) AS pivots FROM deg JOIN (SELECT DISTINCT graph_id, k, n FROM drawn) USING (graph_id) LEFT JOIN b ON b.graph_id = deg.graph_id AND b.v = deg.v")  # fmt: skip
def pivot_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.pivot_betweenness(den_edges(spark, sf_dir), PIVOTS)


@query(f"WITH RECURSIVE {DEG}, {DRAWN}, {REACH}, whole AS (SELECT graph_id, min(r) = any_value(n) AS whole FROM (SELECT graph_id, s, count(*) AS r FROM dist GROUP BY 1, 2) JOIN size USING (graph_id) GROUP BY 1), "
       "src AS (SELECT deg.graph_id, deg.v, size.n FROM deg JOIN whole USING (graph_id) JOIN size USING (graph_id) LEFT JOIN drawn ON drawn.graph_id = deg.graph_id AND drawn.v = deg.v WHERE whole OR drawn.v IS NOT NULL), "
       "e AS (SELECT x.graph_id, x.s, any_value(n) AS n, max(d) AS ecc, sum(d) / CAST(count(*) - 1 AS DOUBLE) AS m FROM src JOIN dist x ON x.graph_id = src.graph_id AND x.s = src.v GROUP BY 1, 2), "
       "q AS (SELECT x.graph_id, quantile_cont(CAST(d AS DOUBLE), 0.9) AS eff FROM src JOIN dist x ON x.graph_id = src.graph_id AND x.s = src.v GROUP BY 1) "
       "SELECT graph_id, CAST(any_value(n) AS INT) AS n_nodes, CAST(count(*) AS INT) AS sources, round(any_value(eff), 6) AS effective_diameter, round(avg(ecc), 6) AS ecc_mean, round(quantile_cont(CAST(ecc AS DOUBLE), 0.9), 6) AS ecc_p90, round(avg(m), 6) AS distance_mean, "
       "round(CASE WHEN count(*) = any_value(n) THEN 0.0 ELSE stddev_samp(m) * sqrt((1 - count(*) / any_value(n)) / count(*)) END, 6) AS distance_error FROM e JOIN q USING (graph_id) GROUP BY 1")  # fmt: skip
def sampled_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sampled_distances(den_edges(spark, sf_dir), PIVOTS)


def _classes(k: int, where: str = "") -> str:
    """SQL: CTEs up to `sets` with h, the digest of each set of `k` vertices, and `kinds`, the connected ones `where` leaves."""
    digest = "md5(graph_id || ':' || " + " || ':' || ".join(f"v{i}" for i in range(1, k + 1)) + " || ':42')"
    return induced_sets_sql(k, digest, where)


@query(f"WITH {MASKS}, {_classes(4, 'h < ' + chr(39) + '40000000' + chr(39))} SELECT graph_id, CAST(n_edges AS BIGINT) AS n_edges, degrees, triangles, count(*) AS sets, round(count(*) / 0.25, 6) AS estimate, round(sqrt(count(*) * 0.75) / 0.25, 6) AS error FROM kinds GROUP BY 1, 2, 3, 4")
def share_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of four vertices, estimated from a quarter of the sets."""
    return sm.sampled_classes(den_edges(spark, sf_dir), 4, share=0.25)


@query(f"WITH {MASKS}, {_classes(5, 'place <= 100')}, size AS (SELECT graph_id, count(*) AS n FROM mask GROUP BY 1), t AS (SELECT graph_id, CAST(n * (n - 1) * (n - 2) * (n - 3) * (n - 4) // 120 AS DOUBLE) AS t FROM size), f AS (SELECT graph_id, n_edges, degrees, triangles, count(*) AS sets FROM kinds GROUP BY 1, 2, 3, 4) "
       "SELECT graph_id, CAST(n_edges AS BIGINT) AS n_edges, degrees, triangles, sets, round(sets / least(t, 100) * t, 6) AS estimate, round(t * sqrt(sets / least(t, 100) * (1 - sets / least(t, 100)) / least(t, 100) * (1 - least(t, 100) / t)), 6) AS error FROM f JOIN t USING (graph_id)")  # fmt: skip
def drawn_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of five vertices, estimated from 100 sets of each graph."""
    return sm.sampled_classes(den_edges(spark, sf_dir, by_graph=True), 5, most=100)
