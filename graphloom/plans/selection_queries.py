"""Registered queries of `operators.selection` and of orbits, cycle membership and spectra by graph, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import preparation as prep
from graphloom.operators import selection as sel
from graphloom.operators import structure as st
from graphloom.operators.invariants import degree_summary
from graphloom.plans.queries import DARTS, PRED, WIDE, query
from graphloom.plans.structure_queries import MASKS, induced_sets_sql
from graphloom.sources.collections import den_edges, predictions, table

FEATURES = [f"f{k}" for k in range(64)]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.wide_features(table(spark, sf_dir, "embeddings"), len(FEATURES))


LONG = "l AS (SELECT vec_id, label % 2 AS y, 'f' || (unnest(range(0, len(embedding)))) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"WITH {LONG}, c AS (SELECT feature, corr(x, y) AS corr FROM l GROUP BY 1) SELECT feature, round(corr, 6) AS corr, CAST(rank() OVER (ORDER BY round(abs(corr), 9) DESC, feature) AS INT) AS place FROM c WHERE abs(corr) >= 0.02")
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the vectors are judged, however many they are."""
    long = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("y"), F.posexplode("embedding").alias("k", "x"))
    return sel.ranked_selection(long.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("feature"), F.col("x").cast("double").alias("x"), "y"), 0.02)


@query(f"WITH {WIDE}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS corr FROM wide" for c in FEATURES) + ") SELECT feature, round(corr, 6) AS corr FROM c WHERE abs(corr) >= 0.05")
def wide_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.selected_features(_wide(spark, sf_dir), FEATURES, "y", 0.05)


TOTAL = " + ".join(f"coalesce(abs({c}), 0)" for c in FEATURES)


@query(f"WITH {WIDE}, t AS (SELECT *, {TOTAL} AS t FROM wide) SELECT vec_id, y, loop, " + ", ".join(f"round(CASE WHEN t > 0 THEN {c} / t ELSE {c} END, 6) AS {c}" for c in FEATURES) + " FROM t")
def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.unit_rows(_wide(spark, sf_dir), FEATURES)


def _place(key: str, seed: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('{seed}-' || {key}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"


@query("WITH w AS (SELECT vec_id, CAST(5 + vec_id % 6 AS INT) AS loop, " + _place("vec_id", 7) + " AS a, " + _place("vec_id", 8) + " AS b FROM embeddings), s AS (SELECT least(CAST(0.1 AS DOUBLE), greatest(CAST(0.05 AS DOUBLE), 1000 / count(*))) AS share, max(loop) AS last FROM w) "
       "SELECT vec_id, loop, a >= CAST(0.8 AS DOUBLE) AS test, a < CAST(0.8 AS DOUBLE) AND a >= CAST(0.8 AS DOUBLE) - share AS small_validation, loop = last AND b < CAST(0.3 AS DOUBLE) AS last_validation FROM w, s")  # fmt: skip
def random_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.splits(table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 6 + 5).cast("int").alias("loop")), "vec_id")


@query(f"WITH {PRED} SELECT loop, count(p) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, min(p) AS low, " + ", ".join(f"round(quantile_cont(p, {q}), 6) AS {n}" for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))) + ", max(p) AS high FROM pred GROUP BY 1")
def described_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.described(predictions(spark, sf_dir), ["loop"], "p")


@query(f"WITH {PRED}, t AS (SELECT loop, CAST(sum(y) AS DOUBLE) AS np, CAST(sum(1 - y) AS DOUBLE) AS nn FROM pred GROUP BY 1), d AS (SELECT DISTINCT loop, p FROM pred), "
       "q AS (SELECT d.loop, sum(1 - x.y) / any_value(nn) AS fx, sum(x.y) / any_value(np) AS r FROM d JOIN pred x ON x.loop = d.loop AND x.p >= d.p JOIN t ON t.loop = d.loop GROUP BY d.loop, d.p UNION ALL SELECT loop, 0, 0 FROM t), "
       "m AS (SELECT loop, fx, max(r) AS r FROM q GROUP BY 1, 2), g AS (SELECT CAST(k AS DOUBLE) / 20 AS x FROM range(0, 21) z(k)), "
       "low AS (SELECT loop, x, max(fx) AS x0 FROM m, g WHERE fx <= x GROUP BY 1, 2), high AS (SELECT loop, x, min(fx) AS x1 FROM m, g WHERE fx > x GROUP BY 1, 2) "
       "SELECT l.loop, l.x, round(CASE WHEN x1 IS NULL THEN a.r ELSE a.r + (b.r - a.r) * (l.x - x0) / (x1 - x0) END, 6) AS recall FROM low l LEFT JOIN high h ON h.loop = l.loop AND h.x = l.x JOIN m a ON a.loop = l.loop AND a.fx = x0 LEFT JOIN m b ON b.loop = l.loop AND b.fx = x1")  # fmt: skip
def interpolated_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.interpolated_curve(predictions(spark, sf_dir), ["loop"])


@query(f"WITH {PRED} SELECT id, pos, loop, y, p, p2 FROM pred WHERE CAST(p >= 0.5 AS INT) <> y")
def misclassified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.misclassified(predictions(spark, sf_dir))


@query(f"WITH {PRED}, {DARTS}, s AS (SELECT graph_id, count(DISTINCT src) AS n_nodes, count(*) // 2 AS n_edges FROM darts GROUP BY 1), f AS (SELECT id // 6 AS graph_id, CASE WHEN p >= 5 THEN 'TP' ELSE 'FN' END AS kind, count(*) AS n, avg(p) AS a FROM pred WHERE y = 1 GROUP BY 1, 2) "
       "SELECT graph_id, kind, n, round(a, 6) AS mean_score, n_nodes, n_edges, round(2 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density FROM f LEFT JOIN s USING (graph_id)")  # fmt: skip
def positive_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("graph_id", F.expr("id div 6"))
    return sel.positive_detail(rows, degree_summary(den_edges(spark, sf_dir)).select("graph_id", "n_nodes", "n_edges"), 5.0)


ORBIT = "unnest([" + ", ".join(f"struct_pack(v := CAST(v{i} AS INT), own := CAST(bit_count(mv{i}) AS INT))" for i in range(1, 5)) + "])"


@query(f"WITH {MASKS}, {induced_sets_sql(4)}, o AS (SELECT graph_id, array_to_string(list_sort([" + ", ".join(f"CAST(bit_count(mv{i}) AS INT)" for i in range(1, 5)) + f"]), '') AS degrees, {ORBIT} AS x FROM w3 WHERE b3 = s) SELECT graph_id, x.v AS v, degrees, x.own AS own, count(*) AS sets FROM o GROUP BY 1, 2, 3, 4")
def vertex_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.vertex_orbits(den_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {DARTS}, path AS (SELECT graph_id, u AS a, v AS z, [u, v] AS seen FROM den UNION ALL SELECT p.graph_id, p.a, d.dst, list_append(p.seen, d.dst) FROM path p JOIN darts d ON d.graph_id = p.graph_id AND d.src = p.z WHERE d.dst > p.a AND NOT list_contains(p.seen, d.dst) AND len(p.seen) < 6), "
       "c AS (SELECT p.graph_id, unnest(p.seen) AS v, len(p.seen) AS length FROM path p JOIN den e ON e.graph_id = p.graph_id AND e.u = p.a AND e.v = p.z WHERE len(p.seen) > 2) SELECT graph_id, v, count(*) // 2 AS cycles, round(avg(length), 6) AS mean_length, CAST(max(length) AS INT) AS max_length, round(CAST(count(*) * sum(length * length) - sum(length) * sum(length) AS DOUBLE) / CAST(count(*) * count(*) AS DOUBLE), 6) AS length_var FROM c GROUP BY 1, 2")  # fmt: skip
def cycle_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.cycle_membership(den_edges(spark, sf_dir))


@query()
def laplacian_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.laplacian_prefix(den_edges(spark, sf_dir))


@query()
def heat_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.heat_signature(den_edges(spark, sf_dir))
