"""Registered queries of `operators.mixed`, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import mixed as mx
from graphloom.plans.queries import CODEG, DEN, NUM, query
from graphloom.sources.collections import den_edges, num_edges

TOTAL = f"{DEN}, {NUM}, tot AS (SELECT graph_id, u, v, 0 AS l FROM den UNION ALL SELECT graph_id, u, v, 1 FROM num), td AS (SELECT graph_id, u AS src, v AS dst, l FROM tot UNION ALL SELECT graph_id, v, u, l FROM tot)"
TRIANGLES = "t AS (SELECT x.graph_id, count(*) AS triangles, count(*) FILTER (x.l <> y.l OR x.l <> z.l) AS mixed_triangles FROM tot x JOIN tot y ON y.graph_id = x.graph_id AND y.u = x.u AND y.v > x.v JOIN tot z ON z.graph_id = x.graph_id AND z.u = x.v AND z.v = y.v GROUP BY 1)"
CYCLES = ("two AS (SELECT x.graph_id, x.dst AS a, y.dst AS b, x.src AS w, x.l + y.l AS s FROM td x JOIN td y ON y.graph_id = x.graph_id AND y.src = x.src AND y.dst > x.dst), "
          "c AS (SELECT x.graph_id, count(*) // 2 AS cycles, count(*) FILTER (x.s + y.s NOT IN (0, 4)) // 2 AS mixed_cycles FROM two x JOIN two y ON y.graph_id = x.graph_id AND y.a = x.a AND y.b = x.b AND y.w > x.w GROUP BY 1)")  # fmt: skip
#: Vertex sets of four in ascending order, from any two of their edges' layers: six left joins of the total layer.
SIX = [(i, j) for i in range(1, 5) for j in range(i + 1, 5)]
SETS = ("v AS (SELECT DISTINCT graph_id, src AS v FROM td), q AS (SELECT a.graph_id, " + ", ".join(f"e{i}{j}.l AS e{i}{j}" for i, j in SIX) + " FROM v a "
        + " ".join(f"JOIN v {n} ON {n}.graph_id = a.graph_id AND {n}.v > {m}.v" for m, n in ("ab", "bc", "cd"))
        + " " + " ".join(f"LEFT JOIN tot e{i}{j} ON e{i}{j}.graph_id = a.graph_id AND e{i}{j}.u = {'abcd'[i - 1]}.v AND e{i}{j}.v = {'abcd'[j - 1]}.v" for i, j in SIX) + "), "
        "k AS (SELECT graph_id, " + " + ".join(f"CAST(e{i}{j} IS NOT NULL AS INT)" for i, j in SIX) + " AS m, " + " + ".join(f"coalesce(e{i}{j}, 0)" for i, j in SIX) + " AS s FROM q), "
        "d AS (SELECT graph_id, count(*) FILTER (m = 5) AS diamonds, count(*) FILTER (m = 5 AND s NOT IN (0, 5)) AS mixed_diamonds, count(*) FILTER (m = 6) AS cliques, count(*) FILTER (m = 6 AND s NOT IN (0, 6)) AS mixed_cliques FROM k GROUP BY 1)")  # fmt: skip
KINDS = {"triangles": 3, "cycles": 4, "diamonds": 4, "cliques": 4}
COUNTS = ", ".join(f"CAST(coalesce({m}{k}, 0) AS BIGINT) AS {m}{k}" for k in KINDS for m in ("", "mixed_"))
SHARES = ", ".join(f"CASE WHEN {k} > 0 THEN round(CAST(mixed_{k} AS DOUBLE) / {k}, 6) END AS mixed_{k}_share" for k in KINDS)
CHOOSE = {3: "(n * (n - 1) * (n - 2) // 6)", 4: "(n * (n - 1) * (n - 2) * (n - 3) // 24)"}
PER_SET = ", ".join(f"CASE WHEN n >= {size} THEN round(CAST(mixed_{k} AS DOUBLE) / {CHOOSE[size]}, 6) END AS mixed_{k}_per_set" for k, size in KINDS.items())


@query(f"WITH {TOTAL}, {TRIANGLES}, {CYCLES}, {SETS}, n AS (SELECT graph_id, count(*) AS n FROM v GROUP BY 1), r AS (SELECT graph_id, n, {COUNTS} FROM n LEFT JOIN t USING (graph_id) LEFT JOIN c USING (graph_id) LEFT JOIN d USING (graph_id)) SELECT *, {SHARES}, {PER_SET} FROM r")
def mixed_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.mixed_motifs(den_edges(spark, sf_dir), num_edges(spark, sf_dir))


@query(f"WITH {CODEG}, p AS (SELECT graph_id, sum(k * (k - 1) // 2) AS pairs, sum(k * (k - 1) // 2) // 2 AS c4 FROM codeg GROUP BY 1) SELECT graph_id, CASE WHEN pairs > 0 THEN CAST(4 * c4 AS DOUBLE) / pairs END AS square_proxy FROM p")
def square_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.square_proxy(den_edges(spark, sf_dir))


@query(f"WITH {TOTAL} SELECT graph_id, src, dst, CAST(l AS INT) AS type FROM td")
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.typed_edges(den_edges(spark, sf_dir), num_edges(spark, sf_dir))
