"""Registered queries of `operators.models`; SQL can't express training, so tests hold them against known answers. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import models as md
from graphloom.operators import preparation as prep
from graphloom.plans.queries import query
from graphloom.sources.collections import table

LOOPS = list(range(5, 11))


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The feature table and all its features."""
    rows = prep.wide_features(table(spark, sf_dir, "embeddings"))
    return rows, prep.feature_names(rows)


@query()
def chain_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    return md.report(md.split_scores(rows, features, md.chain_splits(LOOPS)))


@query()
def pair_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    return md.report(md.split_scores(rows, features, md.pair_splits(LOOPS), "tree"))


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    return md.cross_validated(rows, "vec_id", features, learner="logistic")


@query()
def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    return md.importances(rows, features)


@query()
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    half = len(features) // 2
    groups = {"first": features[:half], "second": features[half:]}
    return md.ablation(rows, groups, F.col("loop") < 10, F.col("loop") == 10, "tree")


@query()
def bootstrap_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    return md.bootstrap_scores(rows, "vec_id", features)


@query()
def cluster_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    return md.cluster_costs(rows, features)


@query()
def value_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _wide(spark, sf_dir)
    return md.regression_metrics(md.value_scores(rows.withColumn("y", F.col("y").cast("double")), features, F.col("loop") < 10, F.col("loop") == 10))
