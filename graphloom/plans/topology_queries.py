"""Registered queries of `operators.topology`, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import topology as tp
from graphloom.operators.invariants import degrees
from graphloom.plans.queries import DARTS, DEG, query
from graphloom.sources.collections import den_edges

FACES = (
    f"{DARTS}, rot AS (SELECT graph_id, src AS v, dst AS a, coalesce(lead(dst) OVER w, min(dst) OVER (PARTITION BY graph_id, src)) AS c FROM darts WINDOW w AS (PARTITION BY graph_id, src ORDER BY dst)), "
    "step AS (SELECT graph_id, a * 100 + v AS d, v * 100 + c AS e FROM rot), "
    "walk AS (SELECT graph_id, d, d AS e FROM step UNION SELECT w.graph_id, w.d, s.e FROM walk w JOIN step s ON s.graph_id = w.graph_id AND s.d = w.e), "
    "orbit AS (SELECT graph_id, d, min(e) AS f, count(*) AS size FROM walk GROUP BY 1, 2), face AS (SELECT graph_id, f, any_value(size) AS size FROM orbit GROUP BY 1, 2)"
)


@query(f"WITH RECURSIVE {FACES} SELECT graph_id, count(*) AS n_faces, round(avg(size), 6) AS face_mean, max(size) AS face_max, count(*) FILTER (size = 3) AS faces_3, count(*) FILTER (size = 4) AS faces_4, count(*) FILTER (size = 5) AS faces_5 FROM face GROUP BY 1")
def face_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.face_summary(tp.ascending_rotation(den_edges(spark, sf_dir)))


@query(f"WITH RECURSIVE {FACES}, met AS (SELECT DISTINCT graph_id, CAST(d // 100 AS INT) AS v, f, size FROM orbit) SELECT graph_id, v, count(*) AS n_faces, round(avg(size), 6) AS face_mean, max(size) AS face_max, round(var_pop(size), 6) AS face_var FROM met GROUP BY 1, 2")
def vertex_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.vertex_faces(tp.ascending_rotation(den_edges(spark, sf_dir)))


@query(f"WITH {DARTS}, mask AS (SELECT graph_id, src AS v, bit_or(CAST(1 AS BIGINT) << dst) AS m FROM darts GROUP BY 1, 2), "
       "g AS (SELECT graph_id, bit_or(CAST(1 AS BIGINT) << v) AS p, count(*) AS n FROM mask GROUP BY 1), s AS (SELECT CAST(range AS BIGINT) AS s FROM range(1, 4096)), "
       "side AS (SELECT graph_id, s, bit_or(m) AS near, sum(bit_count(m & ~s)) AS cut FROM mask, s WHERE (s >> v) & 1 = 1 GROUP BY 1, 2), "
       "x AS (SELECT graph_id, n, min(cut) FILTER (s & p = s AND p & ~s <> 0) AS e, min(bit_count(near & ~s)) FILTER (s & p = s AND p & ~s & ~near <> 0) AS k FROM side JOIN g USING (graph_id) GROUP BY 1, 2) "
       "SELECT graph_id, CAST(coalesce(k, n - 1) AS BIGINT) AS vertex_connectivity, CAST(e AS BIGINT) AS edge_connectivity FROM x")  # fmt: skip
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.connectivity(den_edges(spark, sf_dir))


COMMUNITIES = DEG + ", near AS (SELECT graph_id, src, dst FROM darts UNION ALL SELECT graph_id, v, v FROM deg), c0 AS (SELECT graph_id, v, v AS c FROM deg)" + "".join(
    f", k{i} AS (SELECT n.graph_id, n.src AS v, c, count(*) AS k FROM near n JOIN c{i - 1} l ON l.graph_id = n.graph_id AND l.v = n.dst GROUP BY 1, 2, 3), c{i} AS (SELECT graph_id, v, arg_max(c, k * 100 - c) AS c FROM k{i} GROUP BY 1, 2)" for i in range(1, 9)
)


@query(f"WITH {COMMUNITIES} SELECT graph_id, v, c AS community FROM c8")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.communities(den_edges(spark, sf_dir))


@query(f"WITH {COMMUNITIES}, s AS (SELECT graph_id, c, sum(deg) AS d, count(*) AS size FROM c8 JOIN deg USING (graph_id, v) GROUP BY 1, 2), m AS (SELECT e.graph_id, count(*) AS m, count(*) FILTER (a.c = b.c) AS inside FROM den e JOIN c8 a ON a.graph_id = e.graph_id AND a.v = e.u JOIN c8 b ON b.graph_id = e.graph_id AND b.v = e.v GROUP BY 1) "
       "SELECT graph_id, count(*) AS communities, max(size) AS largest, round(any_value(inside / m), 6) AS inside_share, round(any_value(inside / m) - sum((d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM s JOIN m USING (graph_id) GROUP BY 1")  # fmt: skip
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = den_edges(spark, sf_dir)
    return tp.community_summary(edges, tp.communities(edges))


@query(f"WITH RECURSIVE {DEG}, kz AS (SELECT graph_id, v, CAST(1 AS DOUBLE) AS x, 0 AS i FROM deg UNION ALL SELECT d.graph_id, d.src, 1 + 0.1 * sum(k.x), any_value(k.i) + 1 FROM kz k JOIN darts d ON d.graph_id = k.graph_id AND d.dst = k.v WHERE k.i < 120 GROUP BY 1, 2) "
       "SELECT graph_id, v, round(x / sqrt(sum(x * x) OVER (PARTITION BY graph_id)), 6) AS katz FROM kz WHERE i = 120")  # fmt: skip
def katz_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.spreading_scores(den_edges(spark, sf_dir)).select("graph_id", "v", "katz")


@query()
def eigenvector_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.spreading_scores(den_edges(spark, sf_dir)).select("graph_id", "v", "eigenvector")


@query(f"WITH {DEG}, a AS (SELECT d.graph_id, d.v, any_value(d.deg) + sum(o.deg) AS h FROM deg d JOIN darts x ON x.graph_id = d.graph_id AND x.src = d.v JOIN deg o ON o.graph_id = d.graph_id AND o.v = x.dst GROUP BY 1, 2), b AS (SELECT d.graph_id, d.v, any_value(d.h) + sum(o.h) AS h FROM a d JOIN darts x ON x.graph_id = d.graph_id AND x.src = d.v JOIN a o ON o.graph_id = d.graph_id AND o.v = x.dst GROUP BY 1, 2) "
       "SELECT graph_id, " + ", ".join(f"CAST(sum({t}.{c}) AS BIGINT) AS h{i}_sum, round(avg({t}.{c}), 6) AS h{i}_mean, CAST(max({t}.{c}) AS BIGINT) AS h{i}_max" for i, (t, c) in enumerate((("deg", "deg"), ("a", "h"), ("b", "h")))) + " FROM deg JOIN a USING (graph_id, v) JOIN b USING (graph_id, v) GROUP BY 1")  # fmt: skip
def neighbourhood_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = den_edges(spark, sf_dir)
    return tp.pooled(tp.neighbourhood_sums(edges, degrees(edges).withColumnRenamed("deg", "h")))


TWINS = f"{DARTS}, third AS MATERIALIZED (SELECT w.graph_id, w.p, w.q, w.x FROM (SELECT a.graph_id, a.dst AS p, b.dst AS q, a.src AS x FROM darts a JOIN darts b ON a.graph_id = b.graph_id AND a.src = b.src AND a.dst < b.dst) w JOIN den e ON e.graph_id = w.graph_id AND e.u = w.p AND e.v = w.q), twin AS (SELECT s.graph_id, s.p, s.q, s.x, t.x AS y FROM third s JOIN third t ON t.graph_id = s.graph_id AND t.p = s.p AND t.q = s.q AND s.x < t.x)"


@query(f"WITH {TWINS} SELECT graph_id, p, q, x, y FROM twin")
def double_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.double_triangles(den_edges(spark, sf_dir))


@query(f"WITH {TWINS}, top AS (SELECT graph_id, max(v) + 1 AS z FROM den GROUP BY 1), signed AS (SELECT t.*, e.u, e.v, -1 AS k FROM twin t JOIN den e USING (graph_id)" + "".join(f" UNION ALL SELECT t.*, {c}, z, -1 FROM twin t JOIN top USING (graph_id)" for c in "pqxy") + " UNION ALL SELECT t.*, p, q, 1 FROM twin t UNION ALL SELECT t.*, x, y, 1 FROM twin t) "
       "SELECT graph_id, p, q, x, y, u, v, CAST(sum(k) AS BIGINT) AS exponent FROM signed GROUP BY 1, 2, 3, 4, 5, 6, 7 HAVING sum(k) <> 0")  # fmt: skip
def grown_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.grown(den_edges(spark, sf_dir))


@query(f"WITH {DARTS}, moved AS (SELECT graph_id, CASE WHEN u = 1 THEN 0 ELSE u END AS a, CASE WHEN v = 1 THEN 0 ELSE v END AS b FROM den) SELECT graph_id, least(a, b) AS u, greatest(a, b) AS v, CAST(-count(*) AS BIGINT) AS exponent FROM moved WHERE a <> b GROUP BY 1, 2, 3")
def contracted_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.contracted(den_edges(spark, sf_dir).withColumn("exponent", F.lit(-1).cast("long")), 0, 1)
