"""Splits, selection and scaling of feature tables, and reports on predictions: projections and single aggregates, no window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import correlation, ratio
from graphloom.operators.analysis import curve_points


def selected_features(frame: DataFrame, features: list[str], label: str, least: float = 0.2) -> DataFrame:
    """(feature, corr) of the features whose correlation with the label is at least `least`, either way."""
    stats = [F.struct(F.lit(c).alias("feature"), correlation(F.col(c), F.col(label)).alias("corr")) for c in features]
    return frame.agg(F.array(*stats).alias("s")).select(F.inline("s")).where(F.abs("corr") >= least)


def ranked_selection(long: DataFrame, least: float) -> DataFrame:
    """(feature, corr, place) of a table (feature, x, y): the features whose correlation is at least `least`, either way, the strongest first.

    Correlations that agree to nine digits go by name. A row a feature, so one window holds them.
    """
    found = long.groupBy("feature").agg(F.corr("x", "y").alias("corr")).where(F.abs("corr") >= least)
    return found.withColumn("place", F.rank().over(Window.orderBy(F.round(F.abs("corr"), 9).desc(), "feature")))


def unit_rows(frame: DataFrame, features: list[str]) -> DataFrame:
    """Each row's features over the sum of their absolute values; nulls count as 0 in the sum, and a row of zeros stays."""
    total = sum((F.coalesce(F.abs(c), F.lit(0.0)) for c in features), F.lit(0.0))
    return frame.withColumns({c: F.when(total > 0, F.col(c) / total).otherwise(F.col(c)) for c in features})


def place(key: Column, seed: int) -> Column:
    """A number in [0, 1) that key and seed alone decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def splits(frame: DataFrame, key: str, seed: int = 7, train: float = 0.8, last: float = 0.3) -> DataFrame:
    """`frame` with test, small_validation and last_validation; a row's place is a hash of its key, so adding rows moves none.

    test: 1 - `train` of all rows. small_validation: of the others, min(0.1, max(0.05, 1000 / rows)) of all. last_validation: `last` of the rows of the last loop.
    """
    sizes = frame.agg(F.least(F.lit(0.1), F.greatest(F.lit(0.05), 1000 / F.count(F.lit(1)))).alias("_share"), F.max("loop").alias("_last"))
    at = place(F.col(key), seed)
    rows = frame.join(F.broadcast(sizes))  # one row
    return rows.withColumns({
        "test": at >= train, "small_validation": (at < train) & (at >= train - F.col("_share")), "last_validation": (F.col("loop") == F.col("_last")) & (place(F.col(key), seed + 1) < last),
    }).drop("_share", "_last")


def described(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Number, mean, deviation, least, quartiles and largest of a column, by `keys`."""
    quartiles = [F.percentile(value, q).alias(n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
    return frame.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), *quartiles, F.max(value).alias("high"))


def interpolated_curve(predictions: DataFrame, keys: list[str], steps: int = 20) -> DataFrame:
    """(keys, x, recall): the ROC curve at false rates x = 0, 1 / steps, .., 1, linear between its points, of which the highest counts at one false rate."""
    curve = curve_points(predictions, keys).where("false_rate is not null and recall is not null")
    start = curve.select(*keys, F.lit(0.0).alias("x0"), F.lit(0.0).alias("r0")).distinct()
    points = start.union(curve.select(*keys, "false_rate", "recall")).groupBy(*keys, "x0").agg(F.max("r0").alias("r0"))
    ahead = Window.partitionBy(*keys).orderBy("x0")
    pieces = points.withColumn("x1", F.lead("x0").over(ahead)).withColumn("r1", F.lead("r0").over(ahead))
    grid = pieces.withColumn("x", F.explode(F.array(*(F.lit(k / steps) for k in range(steps + 1))))).where("x >= x0 and (x1 is null or x < x1)")
    return grid.select(*keys, "x", F.when(F.col("x1").isNull(), F.col("r0")).otherwise(F.col("r0") + (F.col("r1") - F.col("r0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))).alias("recall"))


def misclassified(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows on the wrong side of the threshold."""
    return predictions.where((F.col("p") >= threshold).cast("int") != F.col("y"))


def positive_detail(predictions: DataFrame, sizes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Positives by graph as found (TP) or missed (FN), with their mean score, and vertices, edges and density of the graph (null where `sizes`, (graph_id, n_nodes, n_edges), has none)."""
    kind = F.when(F.col("p") >= threshold, "TP").otherwise("FN")
    found = predictions.where("y = 1").groupBy("graph_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_score"))
    return found.join(sizes, "graph_id", "left").withColumn("density", ratio(2 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))
