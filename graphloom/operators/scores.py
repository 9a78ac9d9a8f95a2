"""Comparison of score tables and of rows: alignment, ranks, interpolated curves, confident subsets, similarity of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import ratio


def alignment(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many predictions (keys, y) only one side has, both have, and have with different labels."""
    a, b = first.select(*keys, F.col("y").alias("_a"), F.lit(1).alias("_x")), second.select(*keys, F.col("y").alias("_b"), F.lit(1).alias("_z"))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("_z").isNull()).alias("only_first"), F.count_if(F.col("_x").isNull()).alias("only_second"), F.count_if(F.col("_x").isNotNull() & F.col("_z").isNotNull()).alias("both"), F.count_if(F.col("_a") != F.col("_b")).alias("mismatches"))


def score_ranks(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """`scores` with place: 1 and the number of smaller scores under the same keys.

    Equal scores are counted first, so the window holds distinct scores of a key cut by their first digits, and a second one the cuts.
    """
    counted = scores.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cut", F.floor(F.col(score) * 1000))
    cuts = counted.groupBy(*keys, "_cut").agg(F.sum("_n").alias("_all"))
    before = cuts.withColumn("_start", F.coalesce(F.sum("_all").over(Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_cut").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counted.withColumn("_in", inside).join(before, [*keys, "_cut"]).select(*keys, score, (F.col("_start") + F.col("_in") + 1).alias("place"))
    return scores.join(places, [*keys, score])


def curve_on_grid(points: DataFrame, keys: list[str], x: str, y: str, steps: int = 10) -> DataFrame:
    """Curve points (keys, x, y) at 0, 1 / steps, .. 1 by linear interpolation between neighbours by x; of points with equal x the highest counts, and before the first it is 0 at 0.

    A row asks only for the grid places between it and the next point, so the rows are the points and the grid.
    """
    top = points.groupBy(*keys, x).agg(F.max(y).alias(y))
    w = Window.partitionBy(*keys).orderBy(x)
    spans = top.select(*keys, F.coalesce(F.lag(x).over(w), F.lit(0.0)).alias("_x0"), F.coalesce(F.lag(y).over(w), F.lit(0.0)).alias("_y0"), F.col(x).alias("_x1"), F.col(y).alias("_y1"), F.lag(x).over(w).isNull().alias("_first"))
    low = F.when(F.col("_first"), F.lit(0)).otherwise(F.floor(F.col("_x0") * steps + 1e-9) + 1)
    asked = spans.withColumn("_k", F.explode(F.when(F.floor(F.col("_x1") * steps + 1e-9) >= low, F.sequence(low.cast("int"), F.floor(F.col("_x1") * steps + 1e-9).cast("int")))))
    at = F.col("_k") / F.lit(float(steps))
    width = F.col("_x1") - F.col("_x0")
    value = F.when(width > 0, F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (at - F.col("_x0")) / F.nullif(width, F.lit(0.0))).otherwise(F.col("_y1"))
    return asked.select(*keys, F.col("_k").cast("int").alias("step"), value.alias("value"))


def confident_subset(scores: DataFrame, keys: list[str], doubt: Column, limits: list[float]) -> DataFrame:
    """By keys and limit: the share of rows (y, p) with a doubt up to the limit, their accuracy, and the accuracy where the others count as wrong."""
    rows = scores.withColumn("_doubt", doubt).withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    sure = F.col("_doubt") <= F.col("limit")
    right = sure & ((F.col("p") >= 0.5).cast("int") == F.col("y"))
    n, m, k = F.count(F.lit(1)), F.count_if(sure), F.count_if(right)
    return rows.groupBy(*keys, "limit").agg(ratio(m, n).alias("coverage"), ratio(k, m).alias("accuracy"), ratio(k, n).alias("hard_accuracy"))


def similar_pairs(rows: DataFrame, key: str, columns: list[str], size: int = 100) -> DataFrame:
    """(a, b, same): the share of equal columns for all pairs of a sample of `size` rows, the first by a digest of the key. The sample bounds the pairs."""
    sample = rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(size).select(F.col(key).alias("k"), F.array(*(F.col(c).cast("string") for c in columns)).alias("x"))
    a, b = sample.toDF("a", "xa"), sample.toDF("b", "xb")
    alike = F.aggregate(F.zip_with("xa", "xb", lambda p, q: p.eqNullSafe(q).cast("int")), F.lit(0), lambda t, z: t + z)
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (alike / len(columns)).alias("same"))


#: Lower ends of the ranges of similarity, in hundredths.
BUCKETS = [0, 50, 70, 80, 90, 95, 99]


def similarity_buckets(pairs: DataFrame) -> DataFrame:
    """(bucket, pairs): pairs by the last of BUCKETS that their similarity reaches."""
    bucket = F.lit(BUCKETS[0])
    for low in BUCKETS[1:]:
        bucket = F.when(F.col("same") * 100 >= low, low).otherwise(bucket)
    return pairs.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"))


def column_identity(rows: DataFrame, key: str, columns: list[str], size: int = 100) -> DataFrame:
    """(feature, same): the share of pairs of the sample that agree in a column, from counts of equal values alone."""
    sample = rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(size)
    long = sample.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k")
    return counts.groupBy("feature").agg(ratio(F.sum(F.col("k") * (F.col("k") - 1)), total * (total - 1)).alias("same"))


def run_summary(best: DataFrame, metric: str) -> DataFrame:
    """One row: best, worst, mean, deviation and number of runs by their metric (less is better)."""
    return best.agg(F.min(metric).alias("best"), F.max(metric).alias("worst"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(F.lit(1)).alias("runs"))
