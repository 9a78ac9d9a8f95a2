"""Registered queries of the graph operators and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import finite, nonzero, rational
from graphloom.operators import evaluation as ev
from graphloom.operators import invariants as inv
from graphloom.operators import preparation as prep
from graphloom.sources.collections import den_edges, edge_list_text, graph_labels, num_edges, parse_edge_list, predictions, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DEN = """den AS (SELECT DISTINCT CAST(l_orderkey // 6 AS BIGINT) AS graph_id, CAST(least(l_suppkey % 12, l_partkey % 12) AS INT) AS u, CAST(greatest(l_suppkey % 12, l_partkey % 12) AS INT) AS v
 FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_suppkey % 12 <> l_partkey % 12)"""
DARTS = DEN + ", darts AS (SELECT graph_id, u AS src, v AS dst FROM den UNION ALL SELECT graph_id, v, u FROM den)"
DEG = DARTS + ", deg AS (SELECT graph_id, src AS v, count(*) AS deg FROM darts GROUP BY 1, 2)"
TRI = DEG + ", tri AS (SELECT x.graph_id, x.u AS a, x.v AS b, y.v AS c FROM den x JOIN den y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v JOIN den z ON z.graph_id = x.graph_id AND z.u = x.v AND z.v = y.v)"
CODEG = DEG + ", codeg AS (SELECT x.graph_id, x.dst AS a, y.dst AS b, count(*) AS k FROM darts x JOIN darts y ON x.graph_id = y.graph_id AND x.src = y.src AND x.dst < y.dst GROUP BY 1, 2, 3)"
NUM = """num AS (SELECT n.* FROM (SELECT CAST(l_orderkey // 6 AS BIGINT) AS graph_id, CAST(least(l_suppkey % 12, l_partkey % 12) AS INT) AS u, CAST(greatest(l_suppkey % 12, l_partkey % 12) AS INT) AS v, count(*) AS mult
 FROM lineitem WHERE l_linenumber % 4 = 0 AND l_suppkey % 12 <> l_partkey % 12 GROUP BY 1, 2, 3) n WHERE NOT EXISTS (SELECT 1 FROM den d WHERE d.graph_id = n.graph_id AND d.u = n.u AND d.v = n.v))"""
PRED = "pred AS (SELECT l_orderkey AS id, l_linenumber AS pos, CAST(l_linenumber AS INT) AS loop, CAST(l_returnflag = 'R' AS INT) AS y, round(CAST(l_discount AS DOUBLE) * 10, 6) AS p, round(CAST(l_tax AS DOUBLE) * 10, 6) AS p2 FROM lineitem)"
WIDE = "wide AS (SELECT vec_id, label % 2 AS y, CAST(5 + vec_id % 6 AS INT) AS loop, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS f{k}" for k in range(64)) + " FROM embeddings)"


def query(oracle: str | None = None):
    """Registers a query, its doubles rounded to 6 digits, under its function's name."""

    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = lambda spark, sf_dir: inv.rounded(f(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


@query(f"WITH {DEG}, s AS (SELECT graph_id, count(*) AS n, CAST(sum(deg) // 2 AS BIGINT) AS m, min(deg) AS lo, max(deg) AS hi, avg(deg) AS mean, stddev_pop(deg) AS sd, sum(deg) AS s1, sum(deg * deg) AS s2, sum(deg * deg * deg) AS s3 FROM deg GROUP BY 1), "
       "k AS (SELECT *, CAST(n * s2 - s1 * s1 AS DOUBLE) AS sq, CAST(n * n * s3 - 3 * n * s1 * s2 + 2 * s1 * s1 * s1 AS DOUBLE) AS cu FROM s) "
       "SELECT graph_id, n AS n_nodes, m AS n_edges, lo AS deg_min, hi AS deg_max, round(mean, 6) AS deg_avg, round(sd, 6) AS deg_std, CASE WHEN n > 2 AND sq > 0 THEN round(cu / (sq * sqrt(sq)) * sqrt(CAST(n * (n - 1) AS DOUBLE)) / (n - 2), 6) END AS deg_skew, round(2.0 * m / (n * (n - 1)), 6) AS density, round(m / n, 6) AS edges_per_node FROM k")  # fmt: skip
def degree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.degree_summary(den_edges(spark, sf_dir))


@query(f"WITH {DEG}, c AS (SELECT graph_id, deg, count(*) AS k FROM deg GROUP BY 1, 2), h AS (SELECT graph_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h, sum(k) AS n FROM c GROUP BY 1) SELECT graph_id, round(h, 6) AS entropy, round(h / log2(greatest(n - 1, 2)), 6) AS entropy_norm FROM h")
def degree_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.degree_entropy(den_edges(spark, sf_dir))


@query(f"WITH {DEG}, s AS (SELECT d.graph_id, count(*) AS n, sum(a.deg) AS s, sum(a.deg * a.deg) AS q, sum(a.deg * b.deg) AS p FROM darts d JOIN deg a ON a.graph_id = d.graph_id AND a.v = d.src JOIN deg b ON b.graph_id = d.graph_id AND b.v = d.dst GROUP BY 1) SELECT graph_id, CASE WHEN n * q <> s * s THEN round(CAST(n * p - s * s AS DOUBLE) / CAST(n * q - s * s AS DOUBLE), 6) END AS assortativity FROM s")
def degree_assortativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.assortativity(den_edges(spark, sf_dir))


@query(f"WITH {DEG}, r AS (SELECT graph_id, sum(deg) OVER (PARTITION BY graph_id ORDER BY deg, v ROWS UNBOUNDED PRECEDING) AS cum FROM deg) SELECT graph_id, round((count(*) + 1 - 2 * sum(cum) / max(cum)) / count(*), 6) AS gini FROM r GROUP BY 1")
def degree_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.degree_gini(den_edges(spark, sf_dir))


@query(f"WITH {TRI}, b AS (SELECT graph_id, count(*) AS n, CAST(sum(deg * (deg - 1) // 2) AS BIGINT) AS w FROM deg GROUP BY 1), t AS (SELECT graph_id, count(*) AS t FROM tri GROUP BY 1) SELECT graph_id, coalesce(t, 0) AS triangles, w - 3 * coalesce(t, 0) AS open_wedges, CASE WHEN n >= 3 THEN round(coalesce(t, 0) * 6.0 / (n * (n - 1) * (n - 2)), 6) END AS triangle_share FROM b LEFT JOIN t USING (graph_id)")
def triangle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.triangle_counts(den_edges(spark, sf_dir))


@query(f"WITH {CODEG} SELECT graph_id, CAST(sum(k * (k - 1) // 2) // 2 AS BIGINT) AS four_cycles FROM codeg GROUP BY 1")
def four_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.four_cycles(den_edges(spark, sf_dir))


@query(f"WITH {TRI} SELECT t.graph_id, count(*) AS cliques FROM tri t JOIN den x ON x.graph_id = t.graph_id AND x.u = t.a JOIN den y ON y.graph_id = t.graph_id AND y.u = t.b AND y.v = x.v JOIN den z ON z.graph_id = t.graph_id AND z.u = t.c AND z.v = x.v GROUP BY 1")
def four_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.clique_counts(den_edges(spark, sf_dir), 4)


@query(f"WITH {TRI}, q AS (SELECT t.graph_id, a, b, c, x.v AS d FROM tri t JOIN den x ON x.graph_id = t.graph_id AND x.u = t.a JOIN den y ON y.graph_id = t.graph_id AND y.u = t.b AND y.v = x.v JOIN den z ON z.graph_id = t.graph_id AND z.u = t.c AND z.v = x.v) SELECT q.graph_id, count(*) AS cliques FROM q JOIN den p ON p.graph_id = q.graph_id AND p.u = q.a JOIN den r ON r.graph_id = q.graph_id AND r.u = q.b AND r.v = p.v JOIN den s ON s.graph_id = q.graph_id AND s.u = q.c AND s.v = p.v JOIN den t ON t.graph_id = q.graph_id AND t.u = q.d AND t.v = p.v GROUP BY 1")
def five_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.clique_counts(den_edges(spark, sf_dir), 5)


@query(f"WITH {CODEG}, e AS (SELECT d.graph_id, coalesce(k, 0) AS k FROM den d LEFT JOIN codeg c ON c.graph_id = d.graph_id AND c.a = d.u AND c.b = d.v) SELECT graph_id, round(avg(k), 6) AS emb_mean, round(stddev_pop(k), 6) AS emb_std, round(avg(CAST(k = 0 AS DOUBLE)), 6) AS emb_none, round(avg(CAST(k >= 2 AS DOUBLE)), 6) AS emb_two, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS double_triangles FROM e GROUP BY 1")
def edge_embeddedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.embeddedness(den_edges(spark, sf_dir))


CLUSTERING = f"WITH {TRI}, corner AS (SELECT graph_id, v, count(*) AS t FROM (SELECT graph_id, a AS v FROM tri UNION ALL SELECT graph_id, b FROM tri UNION ALL SELECT graph_id, c FROM tri) GROUP BY 1, 2), lc AS (SELECT d.graph_id, d.v, d.deg, CASE WHEN deg > 1 THEN 2.0 * coalesce(t, 0) / (deg * (deg - 1)) ELSE 0.0 END AS c FROM deg d LEFT JOIN corner k ON k.graph_id = d.graph_id AND k.v = d.v) "


@query(CLUSTERING + "SELECT graph_id, v, deg, round(CAST(c AS DOUBLE), 6) AS clustering FROM lc")
def vertex_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.local_clustering(den_edges(spark, sf_dir))


@query(CLUSTERING + ", e AS (SELECT d.graph_id, d.v, d.deg, greatest(coalesce(t, 0) + d.deg - 2, 1) AS x FROM deg d LEFT JOIN corner k ON k.graph_id = d.graph_id AND k.v = d.v) SELECT e.graph_id, e.v, x AS dual_degree, round(CAST(c AS DOUBLE), 6) AS dual_clustering, round(x / e.deg, 6) AS dual_ratio, round(x * CAST(c AS DOUBLE), 6) AS dual_betweenness, round(x / (e.deg + 1), 6) AS dual_share FROM e JOIN lc ON lc.graph_id = e.graph_id AND lc.v = e.v")
def dual_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.dual_estimates(den_edges(spark, sf_dir))


@query(CLUSTERING + "SELECT graph_id, round(avg(CAST(c AS DOUBLE)), 6) AS clustering_mean, round(quantile_cont(CAST(c AS DOUBLE), 0.1), 6) AS q10, round(quantile_cont(CAST(c AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST(c AS DOUBLE), 0.9), 6) AS q90, round(avg(CAST(c = 0 AS DOUBLE)), 6) AS zero_share FROM lc GROUP BY 1")
def clustering_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("clustering")
    return inv.local_clustering(den_edges(spark, sf_dir)).groupBy("graph_id").agg(F.avg(c).alias("clustering_mean"), *(F.percentile(c, q).alias(n) for q, n in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))), F.avg((c == 0).cast("double")).alias("zero_share"))


@query(f"WITH {DARTS}, w2 AS (SELECT a.graph_id, a.src, b.dst, count(*) AS w FROM darts a JOIN darts b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY 1, 2, 3), w3 AS (SELECT a.graph_id, a.src, b.dst, sum(w) AS w FROM w2 a JOIN darts b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY 1, 2, 3), w4 AS (SELECT a.graph_id, a.src, b.dst, sum(w) AS w FROM w3 a JOIN darts b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY 1, 2, 3), w5 AS (SELECT a.graph_id, a.src, b.dst, sum(w) AS w FROM w4 a JOIN darts b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY 1, 2, 3) "
       + " UNION ALL ".join(f"SELECT graph_id, {k} AS k, CAST(sum(w) AS BIGINT) AS walks FROM w{k} WHERE src = dst GROUP BY 1" for k in (2, 3, 4, 5)))
def closed_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.closed_walks(den_edges(spark, sf_dir, by_graph=True))


@query(f"WITH RECURSIVE {DARTS}, reach AS (SELECT DISTINCT graph_id, src AS s, src AS t, 0 AS d FROM darts UNION SELECT r.graph_id, r.s, x.dst, r.d + 1 FROM reach r JOIN darts x ON x.graph_id = r.graph_id AND x.src = r.t WHERE r.d < 11), dist AS (SELECT graph_id, s, t, min(d) AS d FROM reach GROUP BY 1, 2, 3), comp AS (SELECT graph_id, s, min(t) AS c FROM dist GROUP BY 1, 2) "
       "SELECT graph_id, k AS components, CAST(k = 1 AS INT) AS connected, CAST(diameter AS BIGINT) AS diameter, wiener FROM (SELECT graph_id, max(d) AS diameter, CAST(sum(d) // 2 AS BIGINT) AS wiener FROM dist GROUP BY 1) JOIN (SELECT graph_id, count(DISTINCT c) AS k FROM comp GROUP BY 1) USING (graph_id)")  # fmt: skip
def distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.distance_summary(den_edges(spark, sf_dir))


@query(f"WITH {DEN}, {NUM} SELECT graph_id, count(x) AS first_edges, count(y) AS second_edges, count(x + y) AS common, round(count(x + y) / count(*), 6) AS jaccard FROM (SELECT graph_id, u, v, 1 AS x FROM den) FULL JOIN (SELECT graph_id, u, v, 1 AS y FROM num) USING (graph_id, u, v) GROUP BY 1")
def layer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.layer_overlap(den_edges(spark, sf_dir), num_edges(spark, sf_dir))


@query(f"WITH {DEN}, {NUM}, tot AS (SELECT graph_id, u, v, 0 AS l FROM den UNION ALL SELECT graph_id, u, v, 1 FROM num) SELECT x.graph_id, count(*) AS mixed_triangles FROM tot x JOIN tot y ON x.graph_id = y.graph_id AND x.u = y.u AND x.v < y.v JOIN tot z ON z.graph_id = x.graph_id AND z.u = x.v AND z.v = y.v WHERE x.l <> y.l OR x.l <> z.l GROUP BY 1")
def mixed_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.mixed_triangles(den_edges(spark, sf_dir), num_edges(spark, sf_dir))


@query(f"WITH {TRI}, t AS (SELECT graph_id, count(*) AS t FROM tri GROUP BY 1) SELECT graph_id, CAST(round(2.0 * count(*), 3) AS DOUBLE) AS moment2, CAST(round(6.0 * coalesce(any_value(t), 0), 3) AS DOUBLE) AS moment3 FROM den LEFT JOIN t USING (graph_id) GROUP BY 1")
def spectral_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.spectral_moments(den_edges(spark, sf_dir)).select("graph_id", F.abs(F.round("moment2", 3)).alias("moment2"), F.abs(F.round("moment3", 3)).alias("moment3"))


@query()
def spectrum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.spectral_moments(den_edges(spark, sf_dir))


@query("WITH l AS (SELECT CAST(o_orderkey // 6 AS BIGINT) AS g, max(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 1 ELSE 0 END) AS y FROM orders GROUP BY 1) SELECT CAST(5 + g % 6 AS INT) AS loop, y, count(*) AS graphs FROM l GROUP BY ROLLUP (1, 2)")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.label_balance(graph_labels(spark, sf_dir))


@query(f"WITH {DEN}, t AS (SELECT graph_id, '[' || string_agg('(' || u || ', ' || v || ')', ', ' ORDER BY u, v) || ']' AS edges, count(*) AS n_parsed FROM den GROUP BY 1) SELECT graph_id, edges, n_parsed FROM t")
def edge_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = den_edges(spark, sf_dir).groupBy("graph_id").agg(F.collect_list(F.struct("u", "v")).alias("e")).select("graph_id", edge_list_text(F.col("e")).alias("t"))
    return text.select("graph_id", edge_list_text(parse_edge_list("t")).alias("edges"), F.size(parse_edge_list("t")).cast("long").alias("n_parsed"))


@query("SELECT o_orderkey, round(CAST(o_custkey % 7 - 3 AS DOUBLE) / (o_orderkey % 4), 6) AS value, CAST(o_custkey % 7 - 3 <> 0 AND o_orderkey % 4 <> 0 AS INT) AS nonzero FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 4 = 0")
def rational_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = finite(rational(F.concat_ws("/", F.col("o_custkey") % 7 - 3, F.col("o_orderkey") % 4)))
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), nonzero(value).alias("nonzero"))


@query(f"WITH {PRED}, s AS (SELECT loop, p, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY loop ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT loop, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM w GROUP BY 1")
def roc_auc_by_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.roc_auc(predictions(spark, sf_dir), ["loop"])


@query(f"WITH {PRED}, s AS (SELECT loop, p, sum(y) AS pos, count(*) AS k FROM pred GROUP BY 1, 2), w AS (SELECT *, sum(pos) OVER (PARTITION BY loop ORDER BY p DESC) AS tp, sum(k) OVER (PARTITION BY loop ORDER BY p DESC) AS seen FROM s) SELECT loop, round(sum(pos * tp / seen) / sum(pos), 6) AS ap FROM w GROUP BY 1")
def average_precision_by_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.average_precision(predictions(spark, sf_dir), ["loop"])


@query(f"WITH {PRED}, c AS (SELECT k / 100 AS t, CAST(sum(CASE WHEN p >= k / 100 THEN y ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN p >= k / 100 THEN 1 - y ELSE 0 END) AS DOUBLE) AS fp, sum(y) AS pos, sum(1 - y) AS neg FROM pred, range(1, 100) r(k) GROUP BY 1) SELECT t, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (tp + fp + pos), 6) AS f1, round((tp / pos + (neg - fp) / neg) / 2, 6) AS balanced FROM c")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.threshold_sweep(predictions(spark, sf_dir))


@query(f"WITH {PRED}, m AS (SELECT loop, min(p) FILTER (y = 1) AS low FROM pred GROUP BY 1), r AS (SELECT loop, CAST(sum(y * CAST(p >= 0.5 AS INT)) AS BIGINT) AS tp, CAST(sum((1 - y) * CAST(p >= 0.5 AS INT)) AS BIGINT) AS fp, CAST(sum(y * CAST(p < 0.5 AS INT)) AS BIGINT) AS fn, CAST(sum((1 - y) * CAST(p < 0.5 AS INT)) AS BIGINT) AS tn, round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) AS log_loss, max(low) AS least_positive, CAST(sum(CAST(y = 0 AND p < low AS INT)) AS BIGINT) AS removable FROM pred JOIN m USING (loop) GROUP BY 1) SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall_1, round(tn / (tn + fp), 6) AS recall_0 FROM r")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.metric_row(predictions(spark, sf_dir), ["loop"])


@query(f"WITH {PRED}, s AS (SELECT *, round(CASE WHEN y = 1 THEN 1 - p ELSE p END, 9) AS s FROM pred), c AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM s WHERE id % 5 = 0), q AS (SELECT min(s) AS q FROM c WHERE i >= ceil((n - 1) * 0.9 - 1e-9) + 1), r AS (SELECT loop, CAST(s <= q AS INT) AS a, CAST(round(CASE WHEN y = 1 THEN p ELSE 1 - p END, 9) <= q AS INT) AS b FROM s, q WHERE id % 5 <> 0) SELECT loop, round(avg(a), 6) AS coverage, round(avg(a + b), 6) AS set_size, round(avg(CAST(a + b = 1 AS INT)), 6) AS singletons FROM r GROUP BY 1")
def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.conformal(predictions(spark, sf_dir), F.col("id") % 5 == 0, ["loop"])


@query(f"WITH {PRED} SELECT loop, round(avg(abs(p - p2)), 6) AS mean_abs, round(avg(p - p2), 6) AS mean_diff, CAST(sum(CAST(abs(p - p2) > 0.1 + 1e-9 AS INT)) AS BIGINT) AS far FROM pred GROUP BY 1")
def model_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.disagreement(predictions(spark, sf_dir))


@query(f"WITH {PRED} SELECT p, p2, loop, count(*) AS rows, CAST(sum(y) AS BIGINT) AS ones, CAST(min(y) < max(y) AS INT) AS conflict FROM pred GROUP BY 1, 2, 3 HAVING count(*) > 1")
def conflicting_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.conflicting_labels(predictions(spark, sf_dir), ["p", "p2", "loop"], "y")


LOG = "log AS (SELECT user_id AS run, event_id AS step, value AS metric FROM events)"


@query(f"WITH {LOG}, b AS (SELECT run, step, metric, row_number() OVER (PARTITION BY run ORDER BY metric, step) AS i, count(*) OVER (PARTITION BY run) AS steps FROM log) SELECT run, step AS best_step, round(metric, 6) AS best, steps, CAST(rank() OVER (ORDER BY metric) AS INT) AS place FROM b WHERE i = 1")
def run_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.best_step(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("metric")))


@query("SELECT vec_id, label % 2 AS y, CAST((row_number() OVER (PARTITION BY label % 2 ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS INT) AS fold FROM embeddings")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stratified_folds(table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("y")), "vec_id", ["y"])


@query(f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT 'f{k}' AS feature, round(corr(f{k}, y), 6) AS corr, round(avg(f{k}), 6) AS mean, round(stddev_pop(f{k}), 6) AS std, round(min(f{k}), 6) AS low, round(max(f{k}), 6) AS high, round(avg(CAST(f{k} = 0 AS INT)), 6) AS zeros FROM wide" for k in range(64)))
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.feature_statistics(prep.wide_features(table(spark, sf_dir, "embeddings")), [f"f{k}" for k in range(64)], "y")


@query(f"WITH {WIDE} SELECT vec_id, " + ", ".join(f"round((f{k} - avg(f{k}) OVER (PARTITION BY loop)) / stddev_pop(f{k}) OVER (PARTITION BY loop), 6) AS f{k}" for k in range(64)) + " FROM wide")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.standardised(prep.wide_features(table(spark, sf_dir, "embeddings")), [f"f{k}" for k in range(64)], ["loop"]).select("vec_id", *(f"f{k}" for k in range(64)))


@query(f"WITH {WIDE} SELECT vec_id, y, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)), 6) AS weight FROM wide")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.balanced_weights(prep.wide_features(table(spark, sf_dir, "embeddings")), "y").select("vec_id", "y", "weight")


@query(f"WITH {WIDE}, l AS (" + " UNION ALL ".join(f"SELECT vec_id, {k} AS i, f{k} AS x FROM wide" for k in range(64)) + ") SELECT a.i, b.i AS j, round(corr(a.x, b.x), 6) AS corr FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2")
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.correlations(prep.wide_features(table(spark, sf_dir, "embeddings")), [f"f{k}" for k in range(64)])
