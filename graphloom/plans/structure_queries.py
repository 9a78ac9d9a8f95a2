"""Registered queries of `operators.structure`, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import structure as st
from graphloom.plans.queries import DARTS, DEG, TRI, query
from graphloom.sources.collections import den_edges

REACH = "reach AS (SELECT DISTINCT graph_id, src AS s, src AS t, 0 AS d FROM darts UNION SELECT r.graph_id, r.s, x.dst, r.d + 1 FROM reach r JOIN darts x ON x.graph_id = r.graph_id AND x.src = r.t WHERE r.d < 11), dist AS (SELECT graph_id, s, t, CAST(min(d) AS INT) AS d FROM reach GROUP BY 1, 2, 3)"
PATHS = REACH + ", sp AS (SELECT graph_id, s, t, d, CAST(1 AS BIGINT) AS paths FROM dist WHERE d = 0 UNION ALL SELECT r.graph_id, r.s, x.dst, q.d, CAST(sum(r.paths) AS BIGINT) FROM sp r JOIN darts x ON x.graph_id = r.graph_id AND x.src = r.t JOIN dist q ON q.graph_id = r.graph_id AND q.s = r.s AND q.t = x.dst AND q.d = r.d + 1 GROUP BY 1, 2, 3, 4)"
MASKS = f"{DARTS}, mask AS (SELECT graph_id, src AS v, bit_or(CAST(1 AS BIGINT) << dst) AS m FROM darts GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {DARTS}, {PATHS} SELECT graph_id, s, t, d, paths FROM sp")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.shortest_paths(den_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {DARTS}, {REACH}, e AS (SELECT graph_id, s, max(d) AS ecc, count(*) AS r, sum(d) AS far FROM dist GROUP BY 1, 2), g AS (SELECT graph_id, min(r) = count(*) AS whole, min(ecc) AS lo, max(ecc) AS hi, sum(far) AS far, count(*) AS n, avg(ecc) AS a, stddev_pop(ecc) AS sd, quantile_cont(CAST(ecc AS DOUBLE), 0.9) AS q FROM e GROUP BY 1), p AS (SELECT graph_id, quantile_cont(CAST(d AS DOUBLE), 0.9) AS eff FROM dist GROUP BY 1) "
       "SELECT graph_id, CASE WHEN whole THEN lo END AS radius, CASE WHEN whole THEN round(far / (n * (n - 1)), 6) END AS mean_distance, CASE WHEN whole THEN round(a, 6) END AS ecc_mean, CASE WHEN whole THEN round(sd, 6) END AS ecc_std, CASE WHEN whole THEN round(q, 6) END AS ecc_p90, CASE WHEN whole THEN round(lo / hi, 6) END AS radius_ratio, round(eff, 6) AS effective_diameter FROM g JOIN p USING (graph_id)")  # fmt: skip
def distance_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.distance_profile(den_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {DEG}, {PATHS}, size AS (SELECT graph_id, count(*) AS n FROM deg GROUP BY 1), "
       "b AS (SELECT x.graph_id, x.t AS v, sum(x.paths * y.paths / z.paths) AS b FROM sp x JOIN sp y ON y.graph_id = x.graph_id AND y.s = x.t AND x.d > 0 AND y.d > 0 JOIN sp z ON z.graph_id = x.graph_id AND z.s = x.s AND z.t = y.t AND z.d = x.d + y.d GROUP BY 1, 2), "
       "c AS (SELECT graph_id, s AS v, count(*) AS r, sum(d) AS far, sum(1 / d) AS h FROM sp WHERE d > 0 GROUP BY 1, 2), "
       "pr AS (SELECT graph_id, v, deg, n, CAST(1.0 AS DOUBLE) / n AS x, 0 AS i FROM deg JOIN size USING (graph_id) UNION ALL SELECT q.graph_id, q.v, any_value(q.deg), any_value(q.n), 0.15 / any_value(q.n) + 0.85 * sum(r.x / r.deg), any_value(r.i) + 1 FROM pr r JOIN darts d ON d.graph_id = r.graph_id AND d.src = r.v JOIN (SELECT * FROM deg JOIN size USING (graph_id)) q ON q.graph_id = d.graph_id AND q.v = d.dst WHERE r.i < 30 GROUP BY 1, 2), "
       "alive AS (SELECT graph_id, v, CAST(k AS INT) AS k, 0 AS i FROM deg, range(1, 12) r(k) WHERE deg >= k UNION ALL SELECT a.graph_id, a.v, a.k, a.i + 1 FROM alive a JOIN darts d ON d.graph_id = a.graph_id AND d.src = a.v JOIN alive o ON o.graph_id = d.graph_id AND o.v = d.dst AND o.k = a.k WHERE a.i < 12 GROUP BY 1, 2, 3, 4 HAVING count(*) >= a.k), "
       "core AS (SELECT graph_id, v, max(k) AS core FROM alive WHERE i = 12 GROUP BY 1, 2) "
       "SELECT p.graph_id, p.v, round(coalesce(b, 0) / greatest((n - 1) * (n - 2), 1), 6) AS betweenness, round(r / far * r / (n - 1), 6) AS closeness, round(h, 6) AS harmonic, round(x, 6) AS pagerank, core FROM pr p LEFT JOIN b ON b.graph_id = p.graph_id AND b.v = p.v JOIN c ON c.graph_id = p.graph_id AND c.v = p.v JOIN core k ON k.graph_id = p.graph_id AND k.v = p.v WHERE p.i = 30")  # fmt: skip
def vertex_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.vertex_scores(den_edges(spark, sf_dir))


@query()
def centrality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.score_summary(st.vertex_scores(den_edges(spark, sf_dir)))


@query(f"WITH RECURSIVE {DARTS}, near AS (SELECT graph_id, src AS x, min(dst) AS t FROM darts GROUP BY 1, 2), "
       "away AS (SELECT graph_id, x, t FROM near UNION SELECT r.graph_id, r.x, d.dst FROM away r JOIN darts d ON d.graph_id = r.graph_id AND d.src = r.t WHERE d.dst <> r.x), "
       "cut AS (SELECT DISTINCT d.graph_id, d.src FROM darts d WHERE NOT EXISTS (SELECT 1 FROM away a WHERE a.graph_id = d.graph_id AND a.x = d.src AND a.t = d.dst)), "
       "side AS (SELECT graph_id, u, v, u AS t FROM den UNION SELECT r.graph_id, r.u, r.v, d.dst FROM side r JOIN darts d ON d.graph_id = r.graph_id AND d.src = r.t WHERE NOT (d.src = r.u AND d.dst = r.v) AND NOT (d.src = r.v AND d.dst = r.u)), "
       "bridge AS (SELECT graph_id, u, v FROM den e WHERE NOT EXISTS (SELECT 1 FROM side s WHERE s.graph_id = e.graph_id AND s.u = e.u AND s.v = e.v AND s.t = e.v)), "
       "n AS (SELECT graph_id, count(DISTINCT src) AS n, count(*) // 2 AS m FROM darts GROUP BY 1), c AS (SELECT graph_id, count(*) AS c FROM cut GROUP BY 1), b AS (SELECT graph_id, count(*) AS b FROM bridge GROUP BY 1) "
       "SELECT graph_id, coalesce(c, 0) AS cut_points, coalesce(b, 0) AS bridges, round(coalesce(c, 0) / n, 6) AS cut_share, round(coalesce(b, 0) / m, 6) AS bridge_share FROM n LEFT JOIN c USING (graph_id) LEFT JOIN b USING (graph_id)")  # fmt: skip
def cut_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.cut_counts(den_edges(spark, sf_dir))


def induced_sets_sql(k: int, digest: str = "''", where: str = "") -> str:
    """SQL for the connected induced classes: a self-join of the vertex masks, degrees within the set, and a walk over the set.

    `where` picks sets by h, the SQL text `digest`, or by place, its rank in the graph.
    """
    names = [f"v{i}" for i in range(1, k + 1)]
    joins = "mask v1 " + " ".join(f"JOIN mask v{i} ON v{i}.graph_id = v1.graph_id AND v{i}.v > v{i - 1}.v" for i in range(2, k + 1))
    bits = " | ".join(f"(CAST(1 AS BIGINT) << {v}.v)" for v in names)
    grown = "b0"
    steps = []
    for r in range(1, k):
        steps.append(f"w{r} AS (SELECT *, {grown} | " + " | ".join(f"(CASE WHEN ({grown} >> {v}) & 1 = 1 THEN m{v} ELSE 0 END)" for v in names) + f" AS b{r} FROM " + ("sets" if r == 1 else f"w{r - 1}") + ")")
        grown = f"b{r}"
    meets = " + ".join(f"(CASE WHEN (m{a} >> {b}) & 1 = 1 THEN bit_count(m{a} & m{b}) ELSE 0 END)" for i, a in enumerate(names) for b in names[i + 1 :])
    return (
        f"raw AS (SELECT v1.graph_id, {bits} AS s, " + ", ".join(f"{v}.v AS {v}, {v}.m AS x{v}" for v in names) + f" FROM {joins}), "
        "sets AS (SELECT graph_id, s, CAST(1 AS BIGINT) << v1 AS b0, " + ", ".join(f"{v}, x{v} & s AS m{v}" for v in names) + (f" FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY h) AS place FROM (SELECT *, {digest} AS h FROM raw)) WHERE {where}" if where else " FROM raw") + "), " + ", ".join(steps) + ", "
        "kinds AS (SELECT graph_id, CAST(" + " + ".join(f"bit_count(m{v})" for v in names) + " AS INT) // 2 AS n_edges, array_to_string(list_sort([" + ", ".join(f"CAST(bit_count(m{v}) AS INT)" for v in names) + f"]), '') AS degrees, CAST({meets} AS BIGINT) // 3 AS triangles FROM w{k - 1} WHERE {grown} = s)"
    )


@query(f"WITH {MASKS}, {induced_sets_sql(4)} SELECT graph_id, " + ", ".join(f"count(*) FILTER (degrees = '{d}') AS {n}" for d, n in st.FOUR.items()) + ", count(*) AS connected_sets FROM kinds GROUP BY 1")
def induced_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.induced_four(den_edges(spark, sf_dir))


@query(f"WITH {MASKS}, {induced_sets_sql(5)} SELECT graph_id, CAST(n_edges AS BIGINT) AS n_edges, degrees, triangles, count(*) AS sets FROM kinds GROUP BY 1, 2, 3, 4")
def induced_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.induced_classes(den_edges(spark, sf_dir), 5)


@query(f"WITH RECURSIVE {DARTS}, path AS (SELECT graph_id, u AS a, v AS z, [v] AS seen FROM den UNION ALL SELECT p.graph_id, p.a, d.dst, list_append(p.seen, d.dst) FROM path p JOIN darts d ON d.graph_id = p.graph_id AND d.src = p.z WHERE d.dst > p.a AND NOT list_contains(p.seen, d.dst) AND len(p.seen) < 5) SELECT p.graph_id, CAST(len(p.seen) + 1 AS INT) AS length, count(*) // 2 AS cycles FROM path p JOIN den e ON e.graph_id = p.graph_id AND e.u = p.a AND e.v = p.z WHERE len(p.seen) > 1 GROUP BY 1, 2")
def simple_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.simple_cycles(den_edges(spark, sf_dir))


COLOURS = f"{DEG}, wl AS (SELECT graph_id, v, md5(CAST(deg AS VARCHAR)) AS c, 0 AS i FROM deg UNION ALL SELECT a.graph_id, a.v, md5(any_value(a.c) || '|' || string_agg(b.c, ',' ORDER BY b.c)), any_value(a.i) + 1 FROM wl a JOIN darts d ON d.graph_id = a.graph_id AND d.src = a.v JOIN wl b ON b.graph_id = d.graph_id AND b.v = d.dst WHERE a.i < 3 GROUP BY 1, 2), k AS (SELECT graph_id, c, count(*) AS k FROM wl WHERE i = 3 GROUP BY 1, 2), g AS (SELECT graph_id, count(*) AS colours, max(k) AS largest, md5(string_agg(c || 'x' || k, ',' ORDER BY c || 'x' || k)) AS digest FROM k GROUP BY 1)"


@query(f"WITH RECURSIVE {COLOURS} SELECT graph_id, colours, largest, digest FROM g")
def colour_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.colour_summary(den_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {COLOURS} SELECT digest, count(*) AS graphs, min(graph_id) AS first_graph FROM g GROUP BY 1 HAVING count(*) > 1")
def colour_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.colour_kernel_groups(den_edges(spark, sf_dir))


K5 = "q4 AS (SELECT t.graph_id, a, b, c, x.v AS d FROM tri t JOIN den x ON x.graph_id = t.graph_id AND x.u = t.a JOIN den y ON y.graph_id = t.graph_id AND y.u = t.b AND y.v = x.v JOIN den z ON z.graph_id = t.graph_id AND z.u = t.c AND z.v = x.v), q5 AS (SELECT DISTINCT q.graph_id FROM q4 q JOIN den p ON p.graph_id = q.graph_id AND p.u = q.a JOIN den r ON r.graph_id = q.graph_id AND r.u = q.b AND r.v = p.v JOIN den s ON s.graph_id = q.graph_id AND s.u = q.c AND s.v = p.v JOIN den t ON t.graph_id = q.graph_id AND t.u = q.d AND t.v = p.v)"


@query(f"WITH RECURSIVE {TRI}, {REACH}, {K5}, comp AS (SELECT graph_id, s, min(t) AS c FROM dist GROUP BY 1, 2), k AS (SELECT graph_id, count(*) AS n, count(DISTINCT c) AS c FROM comp GROUP BY 1), m AS (SELECT graph_id, count(*) AS m FROM den GROUP BY 1) SELECT k.graph_id, m - n + c AS cyclomatic, CASE WHEN c = 1 THEN m - n + 2 END AS faces, n - c AS bars, CAST(n < 3 OR m <= 3 * n - 6 AND q5.graph_id IS NULL AS INT) AS planar_possible FROM k JOIN m ON m.graph_id = k.graph_id LEFT JOIN q5 ON q5.graph_id = k.graph_id")
def euler_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.euler_summary(den_edges(spark, sf_dir))


@query()
def spectral_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.spectral_descriptors(den_edges(spark, sf_dir))
