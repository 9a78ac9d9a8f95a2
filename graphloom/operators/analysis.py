"""Curves, thresholds and errors of predictions (loop, y, p), one-component projections, and multiset layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import ratio
from graphloom.operators.evaluation import _by_score
from graphloom.operators.invariants import four_cycles


def curve_points(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, tp, fp, recall, precision, false_rate) with p as the threshold, for each distinct score."""
    down = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    run = _by_score(predictions, keys).select(*keys, "p", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n"))
    return run.select(*keys, "p", "tp", "fp", ratio(F.col("tp"), F.col("_p")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("fp"), F.col("_n")).alias("false_rate"))


def precision_recall_area(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Area below the precision-recall points by trapezoids, from recall 0 with precision 1; null without positives."""
    down = Window.partitionBy(*keys).orderBy(F.desc("p"))
    steps = curve_points(predictions, keys).withColumn("_r", F.lag("recall", 1, 0.0).over(down)).withColumn("_q", F.lag("precision", 1, 1.0).over(down))
    return steps.groupBy(*keys).agg(F.sum((F.col("recall") - F.col("_r")) * (F.col("precision") + F.col("_q")) / 2).alias("area"))


def score_histogram(predictions: DataFrame, bins: int = 20) -> DataFrame:
    """(y, bin, n): scores of each class in `bins` equal parts of [0, 1]; 1 falls in the last."""
    return predictions.groupBy("y", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_loss(predictions: DataFrame, keys: list[str], weight: float = 1.0, least: float = 1e-7) -> DataFrame:
    """Mean logistic loss with positives weighted; scores are kept `least` away from 0 and 1."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - least)), F.lit(least))
    return predictions.groupBy(*keys).agg(F.avg(-(weight * F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("loss"))


def error_rates(predictions: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Rows, right and wrong ones and the share of wrong ones."""
    wrong = F.count_if((F.col("p") >= threshold).cast("int") != F.col("y"))
    return predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - wrong).alias("correct"), wrong.alias("wrong"), (wrong / F.count(F.lit(1))).alias("error_rate"))


def guaranteed_threshold(predictions: DataFrame, train: Column, keys: list[str]) -> DataFrame:
    """The least score of the training positives as a threshold on the other rows, by `keys`.

    (threshold, tp, fn, removed, removed_share, kept, reduction, coverage): negatives below it can go; kept rows are the
    reduced set, coverage the share of positives in it.
    """
    least = predictions.where(train & (F.col("y") == 1)).agg(F.min("p").alias("threshold"))
    rows = predictions.where(~train).join(F.broadcast(least))
    above = F.col("p") >= F.col("threshold")
    n, tp, fn = F.count(F.lit(1)), F.count_if((F.col("y") == 1) & above), F.count_if((F.col("y") == 1) & ~above)
    removed, kept = F.count_if((F.col("y") == 0) & ~above), F.count_if(above)
    return rows.groupBy(*keys, "threshold").agg(tp.alias("tp"), fn.alias("fn"), removed.alias("removed"), (removed / n).alias("removed_share"), kept.alias("kept"), ratio(n, kept).alias("reduction"), ratio(tp, tp + fn).alias("coverage"))


def perfect_cut(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cut, removed): fewest rows whose removal leaves all positives at or above `cut` and all negatives below it, some of both; the smallest such cut."""
    up = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    run = _by_score(predictions, keys).select(*keys, "p", F.coalesce(F.sum("pos").over(up), F.lit(0)).alias("pos_below"), F.coalesce(F.sum("neg").over(up), F.lit(0)).alias("neg_below"), F.sum("pos").over(whole).alias("pos"), F.sum("neg").over(whole).alias("neg"))
    valid = run.where("pos > pos_below and neg_below > 0").withColumn("removed", F.col("pos_below") + F.col("neg") - F.col("neg_below"))
    best = valid.groupBy(*keys).agg(F.min(F.struct("removed", "p")).alias("x"))
    return best.select(*keys, F.col("x.p").alias("cut"), F.col("x.removed").alias("removed"))


def one_component(frame: DataFrame, features: list[str], label: str) -> DataFrame:
    """(corr, r2) of the label with its one-component projection: features weighted by their covariance with it, two passes of aggregates."""
    weights = frame.agg(*(F.covar_samp(c, label).alias(f"_w_{c}") for c in features))
    total = sum((F.col(c) * F.col(f"_w_{c}") for c in features), F.lit(0.0))
    return frame.join(F.broadcast(weights)).select(F.col(label).alias("_y"), total.alias("_t")).agg(F.corr("_t", "_y").alias("corr"), F.regr_r2("_y", "_t").alias("r2"))


def edge_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(graph_id, u, v, mult): edges of the multiset `first` less those of `second`; each of the latter takes one away."""
    keys = ["graph_id", "u", "v"]
    ones = first.select(*keys, F.lit(1).alias("x")).union(second.select(*keys, F.lit(-1).alias("x")))
    counts = ones.groupBy(*keys).agg(F.count_if(F.col("x") > 0).alias("a"), F.count_if(F.col("x") < 0).alias("b"))
    return counts.where("a > b").select(*keys, (F.col("a") - F.col("b")).alias("mult"))


def mixed_four_cycles(first: DataFrame, second: DataFrame) -> DataFrame:
    """(graph_id, mixed): 4-cycles of both layers together that neither layer holds alone."""
    keys = ["graph_id", "u", "v"]
    total = first.select(*keys).union(second.select(*keys)).distinct()
    parts = (four_cycles(x).toDF("graph_id", n) for x, n in ((first.select(*keys), "a"), (second.select(*keys), "b")))
    out = total.select("graph_id").distinct().join(four_cycles(total).toDF("graph_id", "t"), "graph_id", "left").fillna(0, ["t"])
    for p in parts:
        out = out.join(p, "graph_id", "left")
    return out.select("graph_id", F.greatest(F.col("t") - F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)), F.lit(0)).alias("mixed"))


def collection_statistics(edges: DataFrame) -> DataFrame:
    """One row: graphs, vertices (mean, least, most) and edges (mean) of a collection."""
    each = edges.select("graph_id", F.explode(F.array("u", "v")).alias("v")).groupBy("graph_id").agg(F.count_distinct("v").alias("n"), (F.count(F.lit(1)) / 2).alias("m"))
    return each.agg(F.count(F.lit(1)).alias("graphs"), F.avg("n").alias("nodes_mean"), F.min("n").alias("nodes_min"), F.max("n").alias("nodes_max"), F.avg("m").alias("edges_mean"))
