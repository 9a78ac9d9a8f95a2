"""Registered queries of `operators.analysis`, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import analysis as an
from graphloom.operators import preparation as prep
from graphloom.plans.queries import DARTS, DEN, NUM, PRED, WIDE, query
from graphloom.sources.collections import _pairs, den_edges, num_edges, predictions, table

CURVE = f"{PRED}, s AS (SELECT loop, p, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY 1, 2), c AS (SELECT loop, p, CAST(sum(pos) OVER d AS BIGINT) AS tp, CAST(sum(neg) OVER d AS BIGINT) AS fp, sum(pos) OVER w AS np, sum(neg) OVER w AS nn FROM s WINDOW d AS (PARTITION BY loop ORDER BY p DESC), w AS (PARTITION BY loop)), pr AS (SELECT *, tp / np AS r, tp / (tp + fp) AS q FROM c)"


@query(f"WITH {CURVE} SELECT loop, p, tp, fp, round(r, 6) AS recall, round(q, 6) AS precision, round(fp / nn, 6) AS false_rate FROM pr")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.curve_points(predictions(spark, sf_dir), ["loop"])


@query(f"WITH {CURVE}, t AS (SELECT *, lag(r, 1, 0) OVER d AS r0, lag(q, 1, 1) OVER d AS q0 FROM pr WINDOW d AS (PARTITION BY loop ORDER BY p DESC)) SELECT loop, round(sum((r - r0) * (q + q0) / 2), 6) AS area FROM t GROUP BY 1")
def precision_recall_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.precision_recall_area(predictions(spark, sf_dir), ["loop"])


@query(f"WITH {PRED} SELECT y, CAST(least(floor(p * 20), 19) AS INT) AS bin, count(*) AS n FROM pred GROUP BY 1, 2")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.score_histogram(predictions(spark, sf_dir))


@query(f"WITH {PRED}, k AS (SELECT loop, y, greatest(least(p, 1 - 1e-7), 1e-7) AS p FROM pred) SELECT loop, round(avg(-(2.0 * y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss FROM k GROUP BY 1")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.log_loss(predictions(spark, sf_dir), ["loop"], 2.0)


@query(f"WITH {PRED} SELECT loop, count(*) AS total, count(*) FILTER (CAST(p >= 0.5 AS INT) = y) AS correct, count(*) FILTER (CAST(p >= 0.5 AS INT) <> y) AS wrong, round(count(*) FILTER (CAST(p >= 0.5 AS INT) <> y) / count(*), 6) AS error_rate FROM pred GROUP BY 1")
def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.error_rates(predictions(spark, sf_dir), ["loop"])


@query(f"WITH {PRED}, k AS (SELECT id, pos, loop, y, CASE WHEN y = 1 THEN 0.25 + p / 2 ELSE p END AS p FROM pred), t AS (SELECT min(p) AS threshold FROM k WHERE loop <= 5 AND y = 1) "
       "SELECT loop, threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y = 0 AND p < threshold) AS removed, round(count(*) FILTER (y = 0 AND p < threshold) / count(*), 6) AS removed_share, count(*) FILTER (p >= threshold) AS kept, round(count(*) / count(*) FILTER (p >= threshold), 6) AS reduction, round(count(*) FILTER (y = 1 AND p >= threshold) / count(*) FILTER (y = 1), 6) AS coverage FROM k, t WHERE loop > 5 GROUP BY 1, 2")  # fmt: skip
def guaranteed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("p", F.when(F.col("y") == 1, 0.25 + F.col("p") / 2).otherwise(F.col("p")))
    return an.guaranteed_threshold(rows, F.col("loop") <= 5, ["loop"])


@query(f"WITH {PRED}, s AS (SELECT DISTINCT loop, p FROM pred), r AS (SELECT s.loop, s.p, count(*) FILTER (x.y = 1 AND x.p < s.p OR x.y = 0 AND x.p >= s.p) AS removed, count(*) FILTER (x.y = 1 AND x.p >= s.p) AS a, count(*) FILTER (x.y = 0 AND x.p < s.p) AS b FROM s JOIN pred x ON x.loop = s.loop GROUP BY 1, 2) SELECT loop, arg_min(p, removed * 1000 + p) AS cut, min(removed) AS removed FROM r WHERE a > 0 AND b > 0 GROUP BY 1")
def perfect_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.perfect_cut(predictions(spark, sf_dir), ["loop"])


FEATURES = [f"f{k}" for k in range(64)]


@query(f"WITH {WIDE}, w AS (SELECT " + ", ".join(f"covar_samp({c}, y) AS w{c}" for c in FEATURES) + " FROM wide), t AS (SELECT y, " + " + ".join(f"{c} * w{c}" for c in FEATURES) + " AS t FROM wide, w) SELECT round(corr(t, y), 6) AS corr, round(regr_r2(y, t), 6) AS r2 FROM t")
def one_component_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.one_component(prep.wide_features(table(spark, sf_dir, "embeddings"), len(FEATURES)), FEATURES, "y")


@query("WITH x AS (SELECT CAST(l_orderkey // 6 AS BIGINT) AS graph_id, CAST(least(l_suppkey % 12, l_partkey % 12) AS INT) AS u, CAST(greatest(l_suppkey % 12, l_partkey % 12) AS INT) AS v, l_linenumber % 4 = 0 AS num FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12) SELECT graph_id, u, v, count(*) FILTER (NOT num) - count(*) FILTER (num) AS mult FROM x GROUP BY 1, 2, 3 HAVING count(*) FILTER (NOT num) > count(*) FILTER (num)")
def edge_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return an.edge_difference(_pairs(lines.where("l_linenumber % 4 <> 0")), _pairs(lines.where("l_linenumber % 4 = 0")))


def _four(edges: str, name: str) -> str:
    both = f"(SELECT graph_id, u AS a, v AS b FROM {edges} UNION ALL SELECT graph_id, v, u FROM {edges})"
    return f"{name} AS (SELECT graph_id, sum(k * (k - 1) // 2) // 2 AS n FROM (SELECT x.graph_id, x.b AS p, y.b AS q, count(*) AS k FROM {both} x JOIN {both} y ON x.graph_id = y.graph_id AND x.a = y.a AND x.b < y.b GROUP BY 1, 2, 3) GROUP BY 1)"


@query(f"WITH {DEN}, {NUM}, total AS (SELECT graph_id, u, v FROM den UNION SELECT graph_id, u, v FROM num), {_four('total', 't4')}, {_four('den', 'd4')}, {_four('num', 'n4')}, g AS (SELECT DISTINCT graph_id FROM total) SELECT graph_id, CAST(greatest(coalesce(t4.n, 0) - coalesce(d4.n, 0) - coalesce(n4.n, 0), 0) AS BIGINT) AS mixed FROM g LEFT JOIN t4 USING (graph_id) LEFT JOIN d4 USING (graph_id) LEFT JOIN n4 USING (graph_id)")
def mixed_four_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.mixed_four_cycles(den_edges(spark, sf_dir), num_edges(spark, sf_dir))


@query(f"WITH {DARTS}, g AS (SELECT graph_id, count(DISTINCT src) AS n, count(*) / 2 AS m FROM darts GROUP BY 1) SELECT count(*) AS graphs, round(avg(n), 6) AS nodes_mean, min(n) AS nodes_min, max(n) AS nodes_max, round(avg(m), 6) AS edges_mean FROM g")
def collection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.collection_statistics(den_edges(spark, sf_dir))
