"""Evaluation and error analysis of a predictions table (loop, y, p): aggregates and windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import ratio


def _by_score(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score: few rows, whatever the input, before any window."""
    return predictions.groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def roc_auc(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney statistic with ties counted half; null with one class only."""
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = _by_score(predictions, keys).withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    return below.groupBy(*keys).agg(ratio(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over falling scores of precision times the gain in recall."""
    w = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    run = _by_score(predictions, keys).withColumn("tp", F.sum("pos").over(w)).withColumn("seen", F.sum(F.col("pos") + F.col("neg")).over(w))
    return run.groupBy(*keys).agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("ap"))


def threshold_sweep(predictions: DataFrame, steps: int = 99) -> DataFrame:
    """Precision, recall, F1 and balanced accuracy at thresholds k / (steps + 1): scores are counted once, then met with the grid."""
    grid = predictions.sparkSession.range(1, steps + 1).select((F.col("id") / (steps + 1)).alias("t"))
    pos, neg = F.sum("pos"), F.sum("neg")
    tp, fp = F.sum(F.when(F.col("p") >= F.col("t"), F.col("pos")).otherwise(0)), F.sum(F.when(F.col("p") >= F.col("t"), F.col("neg")).otherwise(0))
    counted = _by_score(predictions, []).join(F.broadcast(grid)).groupBy("t").agg(tp.alias("tp"), fp.alias("fp"), pos.alias("pos"), neg.alias("neg"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    precision, recall = zero(F.col("tp"), F.col("tp") + F.col("fp")), zero(F.col("tp"), F.col("pos"))
    return counted.select("t", precision.alias("precision"), recall.alias("recall"), zero(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")).alias("f1"), ((recall + zero(F.col("neg") - F.col("fp"), F.col("neg"))) / 2).alias("balanced"))


def metric_row(predictions: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, both recalls, log loss, least score of a positive and share of negatives below it."""
    hat = (F.col("p") >= threshold).cast("int")
    clipped = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    least = predictions.groupBy(*keys).agg(F.min(F.when(F.col("y") == 1, F.col("p"))).alias("least_positive"))
    out = predictions.join(F.broadcast(least), keys).groupBy(*keys).agg(
        F.sum(F.col("y") * hat).alias("tp"), F.sum((1 - F.col("y")) * hat).alias("fp"), F.sum(F.col("y") * (1 - hat)).alias("fn"), F.sum((1 - F.col("y")) * (1 - hat)).alias("tn"),
        F.avg(-(F.col("y") * F.log(clipped) + (1 - F.col("y")) * F.log(1 - clipped))).alias("log_loss"), F.max("least_positive").alias("least_positive"),
        F.sum(((F.col("y") == 0) & (F.col("p") < F.col("least_positive"))).cast("int")).alias("removable"),
    )
    return out.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).withColumn("recall_1", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("recall_0", ratio(F.col("tn"), F.col("tn") + F.col("fp")))


def conformal(predictions: DataFrame, calibration, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """Coverage and mean size of split-conformal sets: the threshold is the "higher" quantile of 1 - p(true) over `calibration` rows."""
    miss = F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p"))
    counts = predictions.where(calibration).select(F.round(miss, 9).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("n"))
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    q = counts.withColumn("upto", F.sum("k").over(w)).join(F.broadcast(total)).where(F.col("upto") >= F.ceil((F.col("n") - 1) * (1 - alpha) - 1e-9) + 1).agg(F.min("s").alias("q"))
    inside = (F.round(miss, 9) <= F.col("q")).cast("int")
    other = (F.round(1 - miss, 9) <= F.col("q")).cast("int")
    return predictions.where(~calibration).join(F.broadcast(q)).groupBy(*keys).agg(F.avg(inside).alias("coverage"), F.avg(inside + other).alias("set_size"), F.avg((inside + other == 1).cast("int")).alias("singletons"))


def disagreement(predictions: DataFrame, gap: float = 0.1) -> DataFrame:
    """By loop: mean absolute and signed difference of two models' scores, and rows that differ by more than `gap`."""
    d = F.col("p") - F.col("p2")
    return predictions.groupBy("loop").agg(F.avg(F.abs(d)).alias("mean_abs"), F.avg(d).alias("mean_diff"), F.sum((F.abs(d) > gap + 1e-9).cast("int")).alias("far"))


def conflicting_labels(frame: DataFrame, features: list[str], label: str) -> DataFrame:
    """Groups of rows with equal features: size, rows of label 1, and whether labels conflict."""
    return frame.groupBy(*features).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("ones"), (F.min(label) < F.max(label)).cast("int").alias("conflict")).where("rows > 1")


def best_step(log: DataFrame) -> DataFrame:
    """Of a run log (run, step, metric): the step of the least metric (the earliest of equal ones), by run, and the run's rank."""
    best = log.groupBy("run").agg(F.min(F.struct("metric", "step")).alias("b"), F.count(F.lit(1)).alias("steps"))
    return best.select("run", F.col("b.step").alias("best_step"), F.col("b.metric").alias("best"), "steps").withColumn("place", F.rank().over(Window.orderBy("best")))


def stratified_folds(frame: DataFrame, key: str, strata: list[str], folds: int = 5) -> DataFrame:
    """Adds fold: rows of a stratum are dealt out in the order of the key's digest."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key)
    return frame.withColumn("fold", (F.row_number().over(w) - 1) % folds)
