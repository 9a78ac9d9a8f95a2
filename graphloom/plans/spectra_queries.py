"""Registered queries of `operators.spectra` and `operators.cycles`, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import cycles as cy
from graphloom.operators import spectra as sp
from graphloom.operators.guarded import with_errors
from graphloom.operators.structure import edge_lists, stacks
from graphloom.plans.queries import DARTS, DEG, DEN, NUM, query
from graphloom.sources.collections import den_edges, num_edges


@query(f"WITH {DEG} SELECT graph_id, count(*) AS vectors, CAST(0 AS DOUBLE) AS residual, CAST(0 AS DOUBLE) AS overlap FROM deg GROUP BY 1")
def eigenvector_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L x = lambda x and orthonormality of all Laplacian vectors, to six digits."""
    return sp.residuals(den_edges(spark, sf_dir, by_graph=True))


@query(f"WITH {DEG} SELECT graph_id, v, CAST(1 AS DOUBLE) AS moment_0, CAST(deg AS DOUBLE) AS moment_1, CAST(deg * deg + deg AS DOUBLE) AS moment_2 FROM deg")
def laplacian_vertex_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagonals of the Laplacian's powers, from its eigenvectors."""
    return sp.vertex_moments(sp.eigenvectors(den_edges(spark, sf_dir)))


_SIGNED = f"{DEN}, {NUM}, s AS (SELECT graph_id, u, v, 1 AS w FROM den UNION ALL SELECT graph_id, u, v, -mult FROM num), d AS (SELECT graph_id, u AS x, w FROM s UNION ALL SELECT graph_id, v, w FROM s)"


@query(f"WITH {_SIGNED} SELECT graph_id, x AS v, CAST(1 AS DOUBLE) AS moment_0, CAST(sum(abs(w)) AS DOUBLE) AS moment_1, CAST(sum(abs(w)) * sum(abs(w)) + sum(w * w) AS DOUBLE) AS moment_2 FROM d GROUP BY 1, 2")
def signed_vertex_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the signed Laplacian of both layers, the numerator's edges negative."""
    signed = den_edges(spark, sf_dir).withColumn("weight", F.lit(1.0)).union(num_edges(spark, sf_dir).select("graph_id", "u", "v", -F.col("mult").cast("double")))
    return sp.vertex_moments(sp.eigenvectors(signed))


@query()
def extreme_eigenvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.extreme_vectors(sp.eigenvectors(den_edges(spark, sf_dir)))


@query()
def spectral_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sp.positions(sp.eigenvectors(den_edges(spark, sf_dir)))
    return found.select("graph_id", "v", "fiedler", "third", "energy", *(F.get("encoding", F.lit(i)).alias(f"position_{i + 1}") for i in range(5)))


@query(f"WITH RECURSIVE {DEG}, m AS (SELECT graph_id, count(*) AS m FROM den GROUP BY 1), reach AS (SELECT DISTINCT graph_id, src AS s, src AS t FROM darts UNION SELECT r.graph_id, r.s, x.dst FROM reach r JOIN darts x ON x.graph_id = r.graph_id AND x.src = r.t), c AS (SELECT graph_id, s, min(t) AS c FROM reach GROUP BY 1, 2) "
       "SELECT graph_id, CAST(2 * any_value(m) AS DOUBLE) AS total, count(DISTINCT c) AS zeros, CAST(1 AS INT) AS sign FROM c JOIN m USING (graph_id) GROUP BY 1")  # fmt: skip
def eigenvalue_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the Laplacian's eigenvalues, zeros among them, and the sign of the others' product."""
    return sp.eigenvalue_products(sp.eigenvectors(den_edges(spark, sf_dir))).select("graph_id", F.round("total", 5).alias("total"), "zeros", "sign")


#: Every path from its least vertex, and whether an edge closes it.
PATHS = f"{DARTS}, p AS (SELECT graph_id, u AS a, v AS x, (1::BIGINT << u) | (1::BIGINT << v) AS seen, 2 AS n FROM den UNION ALL SELECT p.graph_id, p.a, d.dst, p.seen | (1::BIGINT << d.dst), n + 1 FROM p JOIN darts d ON d.graph_id = p.graph_id AND d.src = p.x WHERE d.dst > p.a AND (p.seen >> d.dst) & 1 = 0 AND n < 11), cyc AS (SELECT p.graph_id, p.seen, n FROM p JOIN den e ON e.graph_id = p.graph_id AND e.u = p.a AND e.v = p.x WHERE n > 2)"


@query(f"WITH RECURSIVE {PATHS}, s AS (SELECT graph_id, count(*) AS n FROM (SELECT DISTINCT graph_id, src FROM darts) GROUP BY 1) SELECT graph_id, c.n AS length, count(*) // 2 AS cycles, round(count(*) // 2 / list_product([(any_value(s.n) - i) / (i + 1) for i in range(c.n)]), 6) AS share FROM cyc c JOIN s USING (graph_id) GROUP BY 1, 2")
def long_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple cycles of 3 to 11 vertices and their share of vertex sets."""
    return cy.cycle_counts(den_edges(spark, sf_dir, by_graph=True))


@query(f"WITH RECURSIVE {PATHS}, o AS (SELECT graph_id, CAST(v AS INT) AS v, n, count(*) // 2 AS k FROM cyc, range(12) r(v) WHERE (seen >> v) & 1 = 1 GROUP BY 1, 2, 3) SELECT graph_id, v, CAST(sum(k) AS BIGINT) AS cycles, round(sum(k * n) / sum(k), 6) AS mean_length, max(n) AS max_length, round(CAST(sum(k) * sum(k * n * n) - sum(k * n) * sum(k * n) AS DOUBLE) / CAST(sum(k) * sum(k) AS DOUBLE), 6) AS length_var FROM o GROUP BY 1, 2")
def long_cycles_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycles of 3 to 11 vertices through each vertex."""
    return cy.cycle_vertices(den_edges(spark, sf_dir, by_graph=True))


@query(f"WITH {DEG}, w AS (SELECT x.graph_id, count(*) AS w FROM darts x JOIN darts y ON y.graph_id = x.graph_id AND y.src = x.dst JOIN darts z ON z.graph_id = x.graph_id AND z.src = y.dst AND z.dst = x.src GROUP BY 1), g AS (SELECT DISTINCT graph_id FROM den) "
       "SELECT graph_id, CASE WHEN graph_id % 97 <> 0 THEN coalesce(w, 0) END AS walks, CAST(graph_id % 97 = 0 AS INT) AS failed FROM g LEFT JOIN w USING (graph_id)")  # fmt: skip
def guarded_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed walks of three steps, where one graph of 97 has a vertex id that no matrix has room for: its row tells the error, the others are worked off."""
    den = den_edges(spark, sf_dir)
    spoiled = den.withColumn("v", F.when(F.col("graph_id") % 97 == 0, F.col("v") + 5000).otherwise(F.col("v")))

    def job(batches):
        for ids, a in stacks(batches):
            yield pd.DataFrame({"graph_id": ids, "walks": np.einsum("bij,bjk,bki->b", a, a, a).astype("int64")})

    found = with_errors(edge_lists(spoiled), "graph_id", job, "walks long")
    return found.select("graph_id", "walks", F.col("error").isNotNull().cast("int").alias("failed"))
