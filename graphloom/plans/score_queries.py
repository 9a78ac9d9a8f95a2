"""Registered queries of `operators.scores`, with their DuckDB SQL; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import analysis as an
from graphloom.operators import evaluation as ev
from graphloom.operators import preparation as prep
from graphloom.operators import scores as sc
from graphloom.plans.analysis_queries import CURVE
from graphloom.plans.queries import LOG, PRED, query
from graphloom.sources.collections import predictions, table


@query(f"WITH {PRED}, a AS (SELECT id, pos, y FROM pred WHERE pos <= 5), b AS (SELECT id, pos, CAST(y = 1 AND id % 50 > 0 AS INT) AS y FROM pred WHERE pos >= 2) SELECT count(*) FILTER (b.id IS NULL) AS only_first, count(*) FILTER (a.id IS NULL) AS only_second, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS \"both\", count(*) FILTER (a.y <> b.y) AS mismatches FROM (SELECT DISTINCT * FROM a) a FULL JOIN (SELECT DISTINCT * FROM b) b ON a.id = b.id AND a.pos = b.pos")
def prediction_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = predictions(spark, sf_dir).select("id", "pos", "y").distinct()
    second = held.where("pos >= 2").withColumn("y", ((F.col("y") == 1) & (F.col("id") % 50 > 0)).cast("int")).distinct()
    return sc.alignment(held.where("pos <= 5"), second, ["id", "pos"])


@query("SELECT vec_id, CAST(NULL AS DOUBLE) AS f0, round(CAST(embedding[2] AS DOUBLE), 6) AS f1, CAST(NULL AS DOUBLE) AS g FROM embeddings")
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with the columns of the training rows: what they lack is null, and what only they have goes."""
    test = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(1)).cast("double").alias("f1"), "label")
    return prep.aligned(test, ["vec_id", "f0", "f1", "g"])


@query(f"WITH {PRED} SELECT id, pos, loop, p, rank() OVER (PARTITION BY loop ORDER BY p) AS place FROM pred")
def score_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.score_ranks(predictions(spark, sf_dir).select("id", "pos", "loop", "p"), ["loop"], "p")


@query(f"WITH {PRED} SELECT id, pos, p FROM pred WHERE y = 1 ORDER BY p DESC, id, pos LIMIT 10")
def top_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten positives of the highest score."""
    return predictions(spark, sf_dir).where("y = 1").select("id", "pos", "p").orderBy(F.desc("p"), "id", "pos").limit(10)


@query(f"WITH {CURVE}, t AS (SELECT loop, fp / nn AS x, max(r) AS y FROM pr GROUP BY ALL), z AS (SELECT loop, coalesce(lag(x) OVER w, 0) AS x0, coalesce(lag(y) OVER w, 0) AS y0, x AS x1, y AS y1, lag(x) OVER w IS NULL AS first FROM t WINDOW w AS (PARTITION BY loop ORDER BY x)) "
       "SELECT loop, CAST(k AS INT) AS step, round(CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (k / 10.0::DOUBLE - x0) / (x1 - x0) ELSE y1 END, 6) AS value FROM z, range(0, 11) g(k) WHERE k <= floor(x1 * 10 + 1e-9) AND (first OR k >= floor(x0 * 10 + 1e-9) + 1)")  # fmt: skip
def curve_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.curve_on_grid(an.curve_points(predictions(spark, sf_dir), ["loop"]), ["loop"], "false_rate", "recall")


@query(f"WITH {PRED} SELECT loop, t AS \"limit\", round(count(*) FILTER (d <= t) / count(*), 6) AS coverage, round(count(*) FILTER (d <= t AND CAST(p >= 0.5 AS INT) = y) / nullif(count(*) FILTER (d <= t), 0), 6) AS accuracy, round(count(*) FILTER (d <= t AND CAST(p >= 0.5 AS INT) = y) / count(*), 6) AS hard_accuracy FROM (SELECT *, round(abs(p - p2), 6) AS d FROM pred), (SELECT unnest([0.05::DOUBLE, 0.15::DOUBLE, 0.35::DOUBLE]) AS t) GROUP BY 1, 2")
def confident_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By what two models differ."""
    return sc.confident_subset(predictions(spark, sf_dir), ["loop"], F.round(F.abs(F.col("p") - F.col("p2")), 6), [0.05, 0.15, 0.35])


_ROWS = "s AS (SELECT o_orderkey AS k, o_orderstatus AS c0, o_orderpriority AS c1, CAST(o_custkey % 4 AS VARCHAR) AS c2, CAST(o_custkey % 3 AS VARCHAR) AS c3 FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100)"
_PAIRS = _ROWS + ", p AS (SELECT a.k AS a, b.k AS b, (CAST(a.c0 = b.c0 AS INT) + CAST(a.c1 = b.c1 AS INT) + CAST(a.c2 = b.c2 AS INT) + CAST(a.c3 = b.c3 AS INT)) / 4 AS same FROM s a JOIN s b ON a.k < b.k)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("c0"), F.col("o_orderpriority").alias("c1"), (F.col("o_custkey") % 4).alias("c2"), (F.col("o_custkey") % 3).alias("c3"))


_COLUMNS = ["c0", "c1", "c2", "c3"]


@query(f"WITH {_PAIRS} SELECT round(avg(same), 6) AS mean, round(median(same), 6) AS median, min(same) AS low, max(same) AS high, count(*) AS pairs FROM p")
def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sc.similar_pairs(_rows(spark, sf_dir), "o_orderkey", _COLUMNS)
    return pairs.agg(F.avg("same").alias("mean"), F.percentile("same", 0.5).alias("median"), F.min("same").alias("low"), F.max("same").alias("high"), F.count(F.lit(1)).alias("pairs"))


@query(f"WITH {_PAIRS} SELECT CAST(CASE WHEN same >= 0.99 THEN 99 WHEN same >= 0.95 THEN 95 WHEN same >= 0.9 THEN 90 WHEN same >= 0.8 THEN 80 WHEN same >= 0.7 THEN 70 WHEN same >= 0.5 THEN 50 ELSE 0 END AS INT) AS bucket, count(*) AS pairs FROM p GROUP BY 1")
def similarity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.similarity_buckets(sc.similar_pairs(_rows(spark, sf_dir), "o_orderkey", _COLUMNS))


@query(f"WITH {_PAIRS} SELECT a, b, same FROM p ORDER BY same DESC, a, b LIMIT 10")
def most_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.similar_pairs(_rows(spark, sf_dir), "o_orderkey", _COLUMNS).orderBy(F.desc("same"), "a", "b").limit(10)


@query(f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT 'c{k}' AS feature, round(avg(CAST(a.c{k} = b.c{k} AS INT)), 6) AS same FROM s a JOIN s b ON a.k < b.k" for k in range(4)))
def column_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.column_identity(_rows(spark, sf_dir), "o_orderkey", _COLUMNS)


@query(f"WITH {LOG}, b AS (SELECT run, min(metric) AS best FROM log GROUP BY 1) SELECT round(min(best), 6) AS best, round(max(best), 6) AS worst, round(avg(best), 6) AS mean, round(stddev_samp(best), 6) AS std, count(*) AS runs FROM b")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("metric"))
    return sc.run_summary(ev.best_step(log), "best")


@query("SELECT user_id AS run, CAST(count(DISTINCT event_type) AS BIGINT) AS tags FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = (SELECT max(event_type) FROM events)) > 0")
def tagged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that carry a tag: here the last of the event types by name."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_type").alias("last"))
    runs = events.groupBy(F.col("user_id").alias("run")).agg(F.collect_set("event_type").alias("tags"))
    return runs.join(F.broadcast(last)).where(F.array_contains("tags", F.col("last"))).select("run", F.size("tags").cast("long").alias("tags"))
