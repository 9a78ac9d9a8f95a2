"""Experiments on features that tell the label apart, and on some that don't."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import models as md


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(600).select("id", (F.col("id") % 3 + 5).cast("int").alias("loop"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"))
    noise = (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) / 1000).alias("noise")
    return x.select("*", F.when(F.col("id") % 11 > 0, F.col("y") * 2.0 + F.pmod("id", F.lit(7)) / 7).alias("good"), noise).cache()


def test_chain(rows):
    found = {(r["experiment"], r["part"], r["loop"]): r for r in md.report(md.split_scores(rows, ["good", "noise"], md.chain_splits([5, 6, 7]), "tree")).collect()}
    assert set(found) == {("5,6>7", "train", 5), ("5,6>7", "train", 6), ("5,6>7", "test", 7)}
    assert found["5,6>7", "test", 7]["n"] == 200 and found["5,6>7", "test", 7]["auc"] > 0.9


@pytest.mark.parametrize("learner", ["logistic", "svm", "forest"])
def test_learners(rows, learner):
    found = md.report(md.split_scores(rows, ["good"], [("x", F.col("loop") < 7, F.col("loop") == 7)], learner, scaled=True)).where("part = 'test'").first()
    assert found["auc"] > 0.9


def test_one_class_is_left_out(rows):
    assert md.split_scores(rows.where("y = 1"), ["good"], md.pair_splits([5, 6])).count() == 0


def test_ablation_and_importance(rows):
    found = {r["features"]: r for r in md.ablation(rows, {"a": ["good"], "b": ["noise"]}, F.col("loop") < 7, F.col("loop") == 7, "tree").collect()}
    assert math.isclose(found["all"]["change"], 0) and found["without a"]["auc"] < 0.7 < found["only a"]["auc"]
    weights = {r["feature"]: r["importance"] for r in md.importances(rows, ["good", "noise"]).collect()}
    assert weights["good"] > weights["noise"]


def test_elbow_and_splits(rows):
    spots = rows.select("id", (F.col("id") % 3 * 100 + F.col("noise")).alias("f"))
    assert [r["k"] for r in md.cluster_costs(spots, ["f"], 6).where("elbow").collect()] == [3]
    assert len(md.combination_splits([5, 6, 7, 8], 8)) == 7 and len(md.pair_splits([5, 6, 7])) == 3


def test_bootstrap(rows):
    found = md.bootstrap_scores(rows, "id", ["good"], runs=3)
    assert found.count() == 600 and found.where("p between 0 and 1 and p_std >= 0").count() == 600
