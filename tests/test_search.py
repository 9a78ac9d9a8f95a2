"""Searches, early stopping, promotion and stacking on features that tell the label apart, and on some that don't."""

import json
import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import search as se

def early():
    return F.col("loop") < 7


def late():
    return F.col("loop") == 7


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(600).select("id", (F.col("id") % 3 + 5).cast("int").alias("loop"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"))
    noise = (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) / 1000).alias("noise")
    return x.select("*", F.when(F.col("id") % 11 > 0, F.col("y") * 2.0 + F.pmod("id", F.lit(7)) / 7).alias("good"), noise).cache()


def test_drawn_params():
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    whole = se.drawn_params(space, 99)
    assert len({json.dumps(p) for p in whole}) == 6 and all(p["a"] in space["a"] and p["b"] in space["b"] for p in whole)
    assert se.drawn_params(space, 3) == se.drawn_params(space, 3) and len(se.drawn_params(space, 3)) == 3
    assert len(se.drawn_params({c: list(range(1000)) for c in "abcdef"}, 2)) == 2  # never lists the space


def test_random_search(rows):
    found = se.random_search(rows, "id", ["good", "noise"], {"maxDepth": [0, 3]}, 5, learner="tree")
    trials = {json.loads(r["params"])["maxDepth"]: r for r in found.trials.collect()}
    assert trials[3]["best"] and not trials[0]["best"] and math.isclose(trials[0]["auc_mean"], 0.5) and trials[3]["auc_mean"] > 0.9
    assert found.model.stages[-1].getOrDefault("maxDepth") == 3
    with pytest.raises(ValueError):
        se.random_search(rows.where("y = 1"), "id", ["good"], {"maxDepth": [1]}, 1, learner="tree")


def test_early_stopping(rows):
    """A perfect feature needs few trees; the held-out rows are never trained on."""
    clear = rows.withColumn("good", F.col("y") * 1.0)
    assert se.early_stopped(clear, "id", ["good"], most=40, tolerance=0.2, share=0.3).stages[-1].getNumTrees < 40
    held = se.hashed_share("id", 0.3)
    wrong = rows.withColumn("good", F.when(held, 1.0 - F.col("y")).otherwise(F.col("y") * 1.0))  # all that is learnt is wrong on the held-out rows
    assert se.early_stopped(wrong, "id", ["good"], most=40, tolerance=0.01, share=0.3).stages[-1].getNumTrees == 1


def test_promotion(spark):
    """Test cluster 1 obeys another rule than training; only its like teaches it."""
    x = spark.range(900).select("id", F.when(F.col("id") < 300, 5).otherwise(7).alias("loop"), F.when(F.col("id") >= 300, (F.col("id") % 3).cast("int")).alias("cluster"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"))
    same, other = F.col("y") * 1.0, 1.0 - F.col("y")
    frame = x.select("*", F.when(F.coalesce(F.col("cluster"), F.lit(0)) == 0, same).otherwise(other).alias("f"), (F.coalesce(F.col("cluster"), F.lit(0)) > 0).cast("double").alias("side"))
    found = se.promoted(frame, ["f", "side"], early(), late(), steps=3).collect()
    assert [(r["step"], r["cluster"]) for r in found if r["chosen"]][0] == (1, 1)
    assert found[0]["cluster"] is None and found[0]["auc"] < 0.6 and [r["auc"] for r in found if r["chosen"]][0] == 1.0
    assert [r["n_test"] for r in found if r["step"] < 2] == [600, 400, 400, 400] and not any(r["chosen"] for r in found if r["step"] == 3)


def test_clusters(rows):
    found = se.clustered(rows, ["good", "noise"], 3, late())
    assert found.where(late()).select("cluster").distinct().count() == 3 and found.where(early() & F.col("cluster").isNotNull()).count() == 0 and found.count() == 600


def test_stacking(rows):
    twice = rows.union(rows.where("id < 30"))  # repeated keys stay apart
    found = se.stacked_scores(twice, "id", {"a": ("tree", ["good"]), "b": ("logistic", ["noise"])}, early(), late())
    assert found.count() == 630 and found.columns == ["id", "part", "loop", "y", "p_a", "p_b", "p"]
    auc = {(r["part"]): r["auc"] for r in se.roc_auc(found.withColumn("p", F.round("p", 9)), ["part"]).collect()}
    assert auc["test"] > 0.9 and auc["train"] > 0.9


def test_stacking_scores_are_of_unseen_rows(rows):
    """A base that can only remember ids knows nothing of the rows of another fold."""
    ids = rows.withColumn("memory", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)).cast("double"))
    found = se.stacked_scores(ids, "id", {"m": ("tree", ["memory"])}, early(), late()).where("part = 'train'")
    assert se.roc_auc(found.withColumn("p", F.round("p_m", 9)), []).first()["auc"] < 0.65


def test_sets_and_best(spark, rows):
    found = {r["features"]: r for r in se.compared_sets(rows, "id", {"good": ["good"], "both": ["good", "noise"], "none": ["noise"]}, 3, "tree").collect()}
    assert {n: r["size"] for n, r in found.items()} == {"good": 1, "both": 2, "none": 1} and all(r["folds"] == 3 for r in found.values())
    assert found["good"]["accuracy_mean"] > 0.9 > 0.65 > found["none"]["accuracy_mean"]
    areas = spark.createDataFrame([("a", 0.9, 0.7), ("c", 0.95, 0.8), ("b", 0.95, 0.8), ("d", 0.99, None)], "experiment string, train_auc double, test_auc double")
    assert se.best_experiment(areas).first()["experiment"] == "b" and se.best_experiment(areas.where("experiment = 'x'")).count() == 0
