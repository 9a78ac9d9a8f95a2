"""Searches over parameters, feature sets and training rows, early stopping and stacking, on top of `operators.models`.

Loops run over trials, never over rows: each fit is a Spark job over the whole table. Folds and held-out shares hang on
a digest of the key, so that they need no sort and a row's place doesn't change with the table's size.
"""

from __future__ import annotations

import json
import random
from functools import reduce
from math import prod
from typing import Any, NamedTuple

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.evaluation import roc_auc
from graphloom.operators.models import LEARNERS, SEED, fold_splits, pipeline, prepared, scored, split_scores
from graphloom.operators.preparation import hashed_share, validation_share

#: Values that the search for boosted trees draws from.
BOOSTED = {
    "maxIter": [5, 10, 20], "maxDepth": [2, 3, 4, 5], "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.6, 0.8, 1.0],
    "featureSubsetStrategy": ["all", "sqrt", "onethird"], "minInstancesPerNode": [1, 4, 16], "minInfoGain": [0.0, 0.001, 0.01], "maxBins": [16, 32, 64],
}


class Search(NamedTuple):
    """trials: (trial, params, auc_mean, auc_std, best); model: the best trial fitted on all rows."""

    trials: DataFrame
    model: Model


def hashed_fold(key: str, folds: int, seed: int = SEED) -> Column:
    """A row's fold, from 0, by a digest of its key and the seed; null keys share one fold."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")


def drawn_params(space: dict[str, list[Any]], count: int, seed: int = SEED) -> list[dict[str, Any]]:
    """`count` different combinations of the values in `space`, all if it has no more."""
    size = prod(map(len, space.values()))
    out = []
    for i in random.Random(seed).sample(range(size), min(count, size)):
        chosen = {}
        for name, values in space.items():
            i, k = divmod(i, len(values))
            chosen[name] = values[k]
        out.append(chosen)
    return out


def random_search(frame: DataFrame, key: str, features: list[str], space: dict[str, list[Any]] = BOOSTED, count: int = 8, folds: int = 3, learner: str = "boosted", seed: int = SEED, parallelism: int = 2) -> Search:
    """`count` drawn combinations, each judged by its area under the curve over `folds` folds (fewer, but two at least, if a class has fewer rows).

    Rows without y take no part; fewer than two rows of either class raise, and so does a fold that the digest leaves empty (a handful of rows).
    """
    rows = prepared(frame, features).where("y is not null")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) != 2 or min(counts.values()) < 2:
        raise ValueError(f"two rows or more of each of two classes are needed, not {counts}")
    rows = rows.withColumn("_fold", hashed_fold(key, max(2, min(folds, *counts.values())), seed)).cache()
    judged = LEARNERS[learner]()
    drawn = drawn_params(space, count, seed)
    grid = [{judged.getParam(n): v for n, v in p.items()} for p in drawn]
    search = CrossValidator(estimator=pipeline(features, judged), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=rows.select(F.max("_fold")).first()[0] + 1, foldCol="_fold", parallelism=parallelism).fit(rows)
    best = max(range(len(drawn)), key=lambda i: search.avgMetrics[i])
    trials = [(i, json.dumps(p, sort_keys=True), float(search.avgMetrics[i]), float(search.stdMetrics[i]), i == best) for i, p in enumerate(drawn)]
    rows.unpersist()
    return Search(frame.sparkSession.createDataFrame(trials, "trial int, params string, auc_mean double, auc_std double, best boolean"), search.bestModel)


def early_stopped(frame: DataFrame, key: str, features: list[str], most: int = 40, tolerance: float = 0.01, share: float | None = None) -> Model:
    """Boosted trees that stop growing once the loss on a held-out share of the rows gets no better by `tolerance` (relative); its last stage tells the trees.

    The share is `preparation.validation_share` of the rows if not given; rows without y take no part.
    """
    rows = prepared(frame, features).where("y is not null").cache()
    held = hashed_share(key, validation_share(rows.count()) if share is None else share)
    learner = GBTClassifier(labelCol="y", seed=SEED, maxIter=most, maxDepth=4, validationIndicatorCol="_held", validationTol=tolerance)
    model = pipeline(features, learner).fit(rows.withColumn("_held", F.coalesce(held, F.lit(False))))
    rows.unpersist()
    return model


def clustered(frame: DataFrame, features: list[str], k: int, where: Column) -> DataFrame:
    """Adds cluster (0 to k - 1): k-means on z-scores of the rows `where` holds for; null for all others."""
    steps = [Imputer(strategy="median", inputCols=features, outputCols=[f"{c}_filled" for c in features]), VectorAssembler(inputCols=[f"{c}_filled" for c in features], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), KMeans(k=k, seed=SEED, featuresCol="_scaled", predictionCol="_cluster")]
    rows = prepared(frame, features)
    model = Pipeline(stages=steps).fit(rows.where(where))
    return model.transform(rows).select(*frame.columns, F.when(where, F.col("_cluster")).alias("cluster"))


def promoted(frame: DataFrame, features: list[str], train: Column, test: Column, steps: int = 3, learner: str = "tree") -> DataFrame:
    """(step, cluster, n_test, auc, chosen): which clusters of the test rows help the rest most when they go to training.

    Step 0 is without any (cluster null). Each later step tries every cluster left, keeps the one with the greatest area
    under the curve on the test rows that stay (ties: the lower number), and builds on it. Clusters whose move leaves
    one class in training or test have no area and are never chosen; the steps end when none is left.
    """
    spark = frame.sparkSession
    left = sorted(r[0] for r in frame.where(test & F.col("cluster").isNotNull()).select("cluster").distinct().collect())
    schema = "step int, cluster int, n_test long, auc double, chosen boolean"
    rows, moved = [], []
    for step in range(steps + 1):
        tries = [moved] if step == 0 else [[*moved, c] for c in left]
        splits = []
        for taken in tries:
            inside = F.col("cluster").isin(taken) & F.col("cluster").isNotNull() if taken else F.lit(False)
            splits.append((str(taken[-1]) if taken else "", train | (test & inside), test & ~inside))
        scores = split_scores(frame, features, splits, learner).where("part = 'test'").withColumn("p", F.round("p", 12)).cache()
        areas = {r["experiment"]: r["auc"] for r in roc_auc(scores, ["experiment"]).collect()}
        sizes = {r["experiment"]: r["count"] for r in scores.groupBy("experiment").count().collect()}
        scores.unpersist()
        known = [c for c in left if areas.get(str(c)) is not None]
        best = max(known, key=lambda c: (areas[str(c)], -c)) if step and known else None
        rows += [(step, taken[-1] if step else None, sizes.get(str(taken[-1]) if step else "", 0), areas.get(str(taken[-1]) if step else ""), step > 0 and taken[-1] == best) for taken in tries]
        if step and best is None:
            break
        if step:
            moved.append(best)
            left.remove(best)
        if not left:
            break
    return spark.createDataFrame(rows, schema)


def _with_score(model: Model, rows: DataFrame, name: str) -> DataFrame:
    out = model.transform(rows)
    return out.select(*rows.columns, vector_to_array("probability" if "probability" in out.columns else "rawPrediction")[1].alias(name))


def stacked_scores(frame: DataFrame, key: str, bases: dict[str, tuple[str, list[str]]], train: Column, test: Column, folds: int = 3, over: str = "logistic") -> DataFrame:
    """(key, part, loop, y, p_<base> .., p): a learner over the scores of others, `bases` by name as (learner, features).

    Its training rows are scored by bases that were fitted without them, fold by fold; test rows by bases fitted on all
    training rows. Scores are added to the rows in place, without a join, so that repeated keys stay apart. Rows without y take no part.
    """
    names = [f"p_{b}" for b in bases]
    every = list(dict.fromkeys(c for _, f in bases.values() for c in f))
    rows = prepared(frame, every).where("y is not null").withColumn("_fold", hashed_fold(key, folds)).cache()

    def added(fitted_on: DataFrame, to: DataFrame) -> DataFrame:
        for b, (learner, features) in bases.items():
            to = _with_score(pipeline(features, LEARNERS[learner]()).fit(fitted_on), to, f"p_{b}")
        return to.select(key, "loop", "y", *names)

    inner = rows.where(train)
    present = [r[0] for r in inner.select("_fold").distinct().orderBy("_fold").collect()]
    apart = reduce(DataFrame.union, (added(inner.where(F.col("_fold") != k), inner.where(F.col("_fold") == k)) for k in present)).cache()
    model = pipeline(names, LEARNERS[over]()).fit(prepared(apart, names))
    final = {"train": apart, "test": added(inner, rows.where(test))}
    return reduce(DataFrame.union, (scored(model, prepared(f, names), [key, F.lit(part).alias("part"), "loop", "y", *names]) for part, f in final.items()))


def compared_sets(frame: DataFrame, key: str, sets: dict[str, list[str]], folds: int = 5, learner: str = "forest") -> DataFrame:
    """(features, size, accuracy_mean, accuracy_std, folds): each named set of features by its accuracy (p of 0.5 and more is 1) over the same folds."""
    rows = frame.withColumn("fold", hashed_fold(key, folds))
    each = []
    for name, features in sets.items():
        right = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
        scores = split_scores(rows, features, fold_splits(folds), learner).where("part = 'test'").groupBy("experiment").agg(F.avg(right).alias("accuracy"))
        each.append(scores.select(F.lit(name).alias("features"), F.lit(len(features)).alias("size"), "accuracy"))
    return reduce(DataFrame.union, each).groupBy("features", "size").agg(F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"), F.count(F.lit(1)).alias("folds"))


def best_experiment(areas: DataFrame) -> DataFrame:
    """The row of (experiment, train_auc, test_auc) with the greatest test area, then training area, then the first name; nulls come last."""
    return areas.orderBy(F.col("test_auc").desc_nulls_last(), F.col("train_auc").desc_nulls_last(), "experiment").limit(1)
