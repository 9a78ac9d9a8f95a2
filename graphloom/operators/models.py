"""Training and experiments on feature tables with pyspark.ml; scores end as predictions tables that `evaluation` reads.

A feature table has y (0 or 1), loop (the partition that experiments train and test on), an id and numeric features.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.evaluation import roc_auc, stratified_folds

SEED = 42
LEARNERS = {
    "boosted": lambda **p: GBTClassifier(seed=SEED, labelCol="y", **({"maxIter": 10, "maxDepth": 4} | p)),
    "forest": lambda **p: RandomForestClassifier(seed=SEED, labelCol="y", **({"numTrees": 20} | p)),
    "tree": lambda **p: DecisionTreeClassifier(seed=SEED, labelCol="y", **({"maxDepth": 5} | p)),
    "logistic": lambda **p: LogisticRegression(labelCol="y", **({"maxIter": 50} | p)),
    "svm": lambda **p: LinearSVC(labelCol="y", **({"fitIntercept": False, "maxIter": 50} | p)),
    "boosted_value": lambda **p: GBTRegressor(seed=SEED, labelCol="y", **({"maxIter": 10, "maxDepth": 4} | p)),
    "forest_value": lambda **p: RandomForestRegressor(seed=SEED, labelCol="y", **({"numTrees": 20} | p)),
}


def prepared(frame: DataFrame, features: list[str]) -> DataFrame:
    """A flag column for every feature, 1 where it is null or not finite; such values become null."""
    bad = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in features}
    return frame.withColumns({f"{c}_missing": bad[c].cast("double") for c in features} | {c: F.when(~bad[c], F.col(c).cast("double")) for c in features})


def pipeline(features: list[str], learner: Estimator, scaled: bool = False) -> Pipeline:
    """Medians for missing values, features and flags in one vector, z-scores if asked, and the learner; all fitted on training rows only."""
    steps = [Imputer(strategy="median", inputCols=features, outputCols=[f"{c}_filled" for c in features]), VectorAssembler(inputCols=[f"{c}_filled" for c in features] + [f"{c}_missing" for c in features], outputCol="raw" if scaled else "features")]
    if scaled:
        steps.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    return Pipeline(stages=[*steps, learner])


def scored(model, frame: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and p: the probability of 1, or the margin or value of learners without one."""
    out = model.transform(frame)
    if "probability" in out.columns:
        return out.select(*keep, vector_to_array("probability")[1].alias("p"))
    return out.select(*keep, (vector_to_array("rawPrediction")[1] if "rawPrediction" in out.columns else F.col("prediction")).alias("p"))


def _usable(train: DataFrame) -> bool:
    return train.select("y").where("y is not null").distinct().limit(2).count() == 2


def split_scores(frame: DataFrame, features: list[str], splits: Iterable[tuple[str, Column, Column]], learner: str = "boosted", scaled: bool = False, **params) -> DataFrame:
    """(experiment, part, loop, y, p) of each (name, training rows, test rows); splits with one training class only are left out.

    The loop runs over experiments, not rows: each fit is a Spark job over the whole table.
    """
    rows = prepared(frame, features).where("y is not null").cache()
    out = []
    for name, train, test in splits:
        part = rows.where(train)
        if _usable(part):
            model = pipeline(features, LEARNERS[learner](**params), scaled).fit(part)
            out += [scored(model, rows.where(where), [F.lit(name).alias("experiment"), F.lit(which).alias("part"), "loop", "y"]) for which, where in (("train", train), ("test", test))]
    none = rows.limit(0).select(F.lit("").alias("experiment"), F.lit("").alias("part"), "loop", "y", F.lit(0.0).alias("p"))
    return reduce(DataFrame.union, out, none)


def report(scores: DataFrame) -> DataFrame:
    """(experiment, part, loop, n, auc): a row for each loop of an experiment's training and test rows."""
    keys = ["experiment", "part", "loop"]
    rounded = scores.withColumn("p", F.round("p", 12))
    return rounded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(roc_auc(rounded, keys), keys)


def pair_splits(loops: list[int]) -> list[tuple[str, Column, Column]]:
    """Train on one loop, test on each larger one."""
    return [(f"{a}>{b}", F.col("loop") == a, F.col("loop") == b) for a, b in combinations(sorted(loops), 2)]


def chain_splits(loops: list[int], least: int = 2) -> list[tuple[str, Column, Column]]:
    """Train on all loops below the test loop, which moves up."""
    found = sorted(loops)
    return [(f"{','.join(map(str, found[:k]))}>{found[k]}", F.col("loop") < found[k], F.col("loop") == found[k]) for k in range(least, len(found))]


def combination_splits(loops: list[int], test: int) -> list[tuple[str, Column, Column]]:
    """Every non-empty set of the other loops for training, for one test loop."""
    others = [x for x in sorted(loops) if x != test]
    return [(f"{','.join(map(str, c))}>{test}", F.col("loop").isin(*c), F.col("loop") == test) for k in range(1, len(others) + 1) for c in combinations(others, k)]


def fold_splits(folds: int = 5) -> list[tuple[str, Column, Column]]:
    """Cross validation over a `fold` column."""
    return [(f"fold {k}", F.col("fold") != k, F.col("fold") == k) for k in range(folds)]


def cross_validated(frame: DataFrame, key: str, features: list[str], folds: int = 5, learner: str = "boosted", **params) -> DataFrame:
    """(part, loop, auc_mean, auc_std, folds) over folds that keep the shares of y and loop; folds without an area are left out."""
    rows = report(split_scores(stratified_folds(frame, key, ["y", "loop"], folds), features, fold_splits(folds), learner, **params))
    return rows.where("auc is not null").groupBy("part", "loop").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.count(F.lit(1)).alias("folds"))


def ablation(frame: DataFrame, groups: dict[str, list[str]], train: Column, test: Column, learner: str = "boosted") -> DataFrame:
    """(features, auc, change): all groups of features, each alone, and all but each; change is against all, on test rows of all loops."""
    names = [c for g in groups.values() for c in g]
    cases = {"all": names} | {f"only {g}": c for g, c in groups.items()} | {f"without {g}": [x for x in names if x not in c] for g, c in groups.items() if len(groups) > 1}
    rows = reduce(DataFrame.union, (split_scores(frame, c, [(n, train, test)], learner) for n, c in cases.items())).where("part = 'test'").withColumn("p", F.round("p", 12))
    auc = roc_auc(rows, ["experiment"])
    whole = auc.where("experiment = 'all'").select(F.col("auc").alias("whole"))
    return auc.join(F.broadcast(whole)).select(F.col("experiment").alias("features"), "auc", (F.col("auc") - F.col("whole")).alias("change"))


def importances(frame: DataFrame, features: list[str], learner: str = "forest") -> DataFrame:
    """(feature, importance) of a tree learner, or of the size of standardised coefficients; a row for each feature."""
    model = pipeline(features, LEARNERS[learner](), scaled=learner == "logistic").fit(prepared(frame, features)).stages[-1]
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(c, abs(float(values[i]))) for i, c in enumerate(features)]
    return frame.sparkSession.createDataFrame(rows, "feature string, importance double")


def bootstrap_scores(frame: DataFrame, key: str, features: list[str], runs: int = 5, learner: str = "tree") -> DataFrame:
    """(key, y, loop, p, p_std): mean and deviation of the probability over models trained on rows drawn with replacement."""
    rows = prepared(frame, features).cache()
    each = []
    for k in range(runs):
        drawn = rows.sample(withReplacement=True, fraction=1.0, seed=SEED + k)
        if _usable(drawn):
            each.append(scored(pipeline(features, LEARNERS[learner]()).fit(drawn), rows, [key, "y", "loop"]))
    if not each:
        return rows.limit(0).select(key, "y", "loop", F.lit(0.0).alias("p"), F.lit(0.0).alias("p_std"))
    return reduce(DataFrame.union, each).groupBy(key, "y", "loop").agg(F.avg("p").alias("p"), F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("p_std"))


def cluster_costs(frame: DataFrame, features: list[str], most: int = 8) -> DataFrame:
    """(k, cost, bend, elbow) of k-means with 2 to `most` clusters of z-scores; the elbow is where the cost bends most."""
    filled = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=[f"{c}_filled" for c in features]), VectorAssembler(inputCols=[f"{c}_filled" for c in features], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)])
    rows = prepared(frame, features)
    rows = filled.fit(rows).transform(rows).select("features").cache()
    costs = [(k, float(KMeans(k=k, seed=SEED).fit(rows).summary.trainingCost)) for k in range(2, most + 1)]
    order = Window.partitionBy(F.lit(0)).orderBy("k")
    bent = frame.sparkSession.createDataFrame(costs, "k int, cost double").withColumn("bend", F.lag("cost").over(order) - 2 * F.col("cost") + F.lead("cost").over(order))
    return bent.withColumn("elbow", F.coalesce(F.col("bend") == F.max("bend").over(Window.partitionBy(F.lit(0))), F.lit(False)))


def regression_metrics(values: DataFrame, near: float = 0.5) -> DataFrame:
    """Mean squared error, R2 and the share of errors of `near` and more, of (y, p)."""
    error = F.col("y") - F.col("p")
    return values.agg(F.avg(error * error).alias("mse"), (1 - F.sum(error * error) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("r2"), F.avg((F.abs(error) >= near).cast("int")).alias("far_share"))


def value_scores(frame: DataFrame, features: list[str], train: Column, test: Column, learner: str = "boosted_value") -> DataFrame:
    """(y, p) on the test rows of a regression of y."""
    rows = prepared(frame, features).where("y is not null")
    return scored(pipeline(features, LEARNERS[learner]()).fit(rows.where(train)), rows.where(test), ["y"])
