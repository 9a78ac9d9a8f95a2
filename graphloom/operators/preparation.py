"""Feature tables: statistics, scaling, weights and column selection in single aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import correlation, finite, nonzero, rational


def wide_features(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """(vec_id, y, loop, f0, ..): array features as columns, the first `width` or else as many as the longest array has; null where an array is shorter."""
    if width is None:
        width = max(0, vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)
    return vectors.select("vec_id", (F.col("label") % 2).alias("y"), (F.col("vec_id") % 6 + 5).cast("int").alias("loop"), *(F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(width)))


def feature_names(frame: DataFrame) -> list[str]:
    """The feature columns of `wide_features`, in order."""
    return [c for c in frame.columns if re.fullmatch(r"f\d+", c)]


def feature_statistics(frame: DataFrame, features: list[str], label: str) -> DataFrame:
    """Correlation with the label, mean, deviation, extremes and share of zeros: one pass, a row for each feature."""
    stats = [F.struct(F.lit(c).alias("feature"), correlation(F.col(c), F.col(label)).alias("corr"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg((F.col(c) == 0).cast("int")).alias("zeros")) for c in features]
    return frame.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def correlations(frame: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, corr) for i < j over rows where both are set; null where either is constant.

    A task adds up the products of its rows' features as matrices, so the shuffle holds a row for each pair and batch, whatever the number of rows.
    """
    d = len(features)
    i, j = np.triu_indices(d, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((6, len(i)))
        for batch in batches:
            x = batch.to_numpy(float)
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            m = m.astype(float)
            first, second = x.T @ m, (x * x).T @ m
            sums += np.stack([(m.T @ m)[i, j], first[i, j], first[j, i], second[i, j], second[j, i], (x.T @ x)[i, j]])
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), **{f"s{k}": sums[k] for k in range(6)}})

    parts = frame.select(*(F.col(c).cast("double").alias(c) for c in features)).mapInPandas(run, "i int, j int, " + ", ".join(f"s{k} double" for k in range(6)))
    n, a, b, aa, bb, ab = (F.col(f"s{k}") for k in range(6))
    spread = (n * aa - a * a) * (n * bb - b * b)
    total = parts.groupBy("i", "j").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(6)))
    return total.select("i", "j", F.when(spread > 0, (n * ab - a * b) / F.sqrt(F.greatest(spread, F.lit(1e-300)))).alias("corr"))


def uncorrelated(frame: DataFrame, features: list[str], most: float = 0.9) -> list[str]:
    """Features of which no earlier one has a larger absolute correlation than `most`."""
    drop = {r["j"] for r in correlations(frame, features).where(F.abs("corr") > most).collect()}
    return [c for k, c in enumerate(features) if k not in drop]


def standardised(frame: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Features less their mean, over their population deviation, within `keys`: aggregates, joined back by the keys."""
    stats = frame.groupBy(*keys).agg(*(F.avg(c).alias(f"_m_{c}") for c in features), *(F.stddev_pop(c).alias(f"_s_{c}") for c in features))
    joined = frame.join(stats, keys)
    return joined.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) for c in features}).select(frame.columns)


def balanced_weights(frame: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows over (classes times rows of the class); counts are joined, so no window holds a class."""
    counts = frame.groupBy(label).agg(F.count(F.lit(1)).alias("_k"))
    totals = counts.agg(F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_c"))
    weights = counts.join(F.broadcast(totals)).select(label, (F.col("_n") / (F.col("_c") * F.col("_k"))).alias("weight"))
    return frame.join(F.broadcast(weights), label)


def drop_empty(frame: DataFrame, keep: list[str]) -> DataFrame:
    """Drops columns without any value, except `keep`."""
    counts = frame.agg(*(F.count(c).alias(c) for c in frame.columns)).first()
    return frame.select([c for c in frame.columns if c in keep or counts[c]])


def numeric_only(frame: DataFrame, keep: list[str]) -> DataFrame:
    """Text columns read as numbers or fractions, null where neither; columns without any number go, except `keep`."""
    texts = [c for c, kind in frame.dtypes if kind == "string" and c not in keep]
    return drop_empty(frame.withColumns({c: finite(rational(F.col(c))) for c in texts}), keep)


def without_nulls(frame: DataFrame, keep: list[str]) -> DataFrame:
    """Drops columns that hold any null, except `keep`."""
    counts = frame.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(c).alias(c) for c in frame.columns)).first()
    return frame.select([c for c in frame.columns if c in keep or counts[c] == counts["_rows"]])


def fraction_transform(frame: DataFrame, columns: list[str], mode: str, share: float = 0.5) -> DataFrame:
    """Text columns of whose values at least `share` are numbers or fractions, as numbers ("float"), as 0 and 1 ("binary"), or unchanged ("none"); one aggregate decides."""
    if mode not in ("none", "float", "binary"):
        raise ValueError(f"mode is none, float or binary, not {mode}")
    if mode == "none":
        return frame
    seen = frame.agg(*(F.count(rational(F.col(c))).alias(f"_{c}") for c in columns), *(F.count(c).alias(c) for c in columns)).first()
    chosen = [c for c in columns if seen[c] and seen[f"_{c}"] >= share * seen[c]]
    return frame.withColumns({c: rational(F.col(c)) if mode == "float" else nonzero(rational(F.col(c))) for c in chosen})


def hashed_share(key: str, share: float) -> Column:
    """Whether a row is in the first `share` by the digest of its key: the same rows at every size, without a sort."""
    return F.md5(F.col(key).cast("string")) < F.lit(f"{int(share * (1 << 32)):08x}")


def validation_share(rows: int) -> float:
    """A tenth at most, a twentieth at least, and else a thousand rows."""
    return min(0.1, max(0.05, 1000 / max(1, rows)))


def aligned(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The frame's columns named in `columns`, in that order; columns that it lacks are null."""
    return frame.select(*(F.col(c) if c in frame.columns else F.lit(None).cast("double").alias(c) for c in columns))
