"""Registered queries of `operators.search`; SQL can't express training, so tests hold them against known answers. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import models as md
from graphloom.operators import preparation as prep
from graphloom.operators import search as se
from graphloom.operators.evaluation import roc_auc
from graphloom.plans.queries import query
from graphloom.sources.collections import table

#: A narrower space than `search.BOOSTED`, for single trees.
TREES = {"maxDepth": [2, 3, 4, 5, 6], "minInstancesPerNode": [1, 2, 4, 8, 16], "minInfoGain": [0.0, 0.001, 0.01], "maxBins": [16, 32, 64], "impurity": ["gini", "entropy"]}


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    rows = prep.wide_features(table(spark, sf_dir, "embeddings"))
    return rows, prep.feature_names(rows)


def _early() -> Column:
    return F.col("loop") < 10


def _late() -> Column:
    return F.col("loop") == 10


@query()
def parameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of 450 settings of a tree, judged on the training loops."""
    rows, features = _wide(spark, sf_dir)
    return se.random_search(rows.where(_early()), "vec_id", features, TREES, 6, learner="tree").trials


@query()
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by loop of boosted trees that stopped growing, and how many trees there are."""
    rows, features = _wide(spark, sf_dir)
    model = se.early_stopped(rows.where(_early()), "vec_id", features, most=20, share=0.2)
    ready = md.prepared(rows, features).where("y is not null")
    scores = md.scored(model, ready, [F.lit("stopped").alias("experiment"), F.when(_early(), "train").otherwise("test").alias("part"), "loop", "y"])
    return md.report(scores).withColumn("trees", F.lit(model.stages[-1].getNumTrees))


@query()
def cluster_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    return se.promoted(se.clustered(rows, features, 4, _late()), features, _early(), _late(), steps=2)


@query()
def stacked_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of two models, each on half of the features, and of the learner over both."""
    rows, features = _wide(spark, sf_dir)
    half = len(features) // 2
    scores = se.stacked_scores(rows, "vec_id", {"first": ("logistic", features[:half]), "second": ("tree", features[half:])}, _early(), _late())
    long = scores.select("part", "y", F.inline(F.array(*(F.struct(F.lit(n).alias("score"), F.round(c, 12).alias("p")) for n, c in (("first", "p_first"), ("second", "p_second"), ("stacked", "p"))))))
    return roc_auc(long, ["part", "score"])


@query()
def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    sets = {"minimal": features[:4], "balanced": features[: len(features) // 2], "full": features}
    return se.compared_sets(rows, "vec_id", sets, folds=3, learner="tree")


_AREAS = (
    "l AS (SELECT vec_id, label % 2 AS y, CASE WHEN 5 + vec_id % 6 < 10 THEN 'train' ELSE 'test' END AS part, 'f' || (unnest(range(0, len(embedding)))) AS experiment, round(CAST(unnest(embedding) AS DOUBLE), 6) AS p FROM embeddings), "
    "r AS (SELECT experiment, part, y, rank() OVER w + (count(*) OVER (PARTITION BY experiment, part, p) - 1) / 2.0 AS r FROM l WHERE y IS NOT NULL AND p IS NOT NULL WINDOW w AS (PARTITION BY experiment, part ORDER BY p)), "
    "a AS (SELECT experiment, part, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM r GROUP BY 1, 2)"
)


@query(f"WITH {_AREAS}, b AS (SELECT experiment, round(max(auc) FILTER (part = 'train'), 6) AS train_auc, round(max(auc) FILTER (part = 'test'), 6) AS test_auc FROM a GROUP BY 1) SELECT * FROM b ORDER BY test_auc DESC NULLS LAST, train_auc DESC NULLS LAST, experiment LIMIT 1")
def best_single_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of the vectors that ranks the test loop best by itself."""
    long = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("y"), F.when(F.col("vec_id") % 6 < 5, "train").otherwise("test").alias("part"), F.posexplode("embedding").alias("k", "x"))
    scores = long.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("experiment"), "part", "y", F.round(F.col("x").cast("double"), 6).alias("p")).where("y is not null and p is not null")
    auc = roc_auc(scores, ["experiment", "part"]).groupBy("experiment").agg(*(F.round(F.max(F.when(F.col("part") == p, F.col("auc"))), 6).alias(f"{p}_auc") for p in ("train", "test")))
    return se.best_experiment(auc)
