"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named input table, cut to `columns` so that the scan reads no others."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a session on one machine takes a temporary folder, and one on a cluster raises."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written(frame: DataFrame, label: str) -> DataFrame:
    """`frame` as a table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bounded_batches(spark: SparkSession, limit: int = SLICE_BYTES) -> None:
    """From now on, Python workers of this session get batches of about `limit` bytes (one row at least), not of 10,000 rows or 64 MB, which the executor and the worker hold several times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that `column` holds about `limit` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64) + 16) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(int(a), int(b - a))


def ranked(frame: DataFrame, group: list[str], by: str, order: list[Column], width: int, name: str) -> DataFrame:
    """Adds `name`: the row's place, from 0 and without gaps, in its `group`, by `by` and then `order`.

    One window over a whole group would be one task. Here `by` (a long, null as the smallest) is cut into
    ranges of `width` values; each range is numbered alone and moved by the sizes of the ranges before it.
    """
    cut = frame.withColumn("_cut", F.coalesce(F.floor(F.col(by) / F.lit(width)), F.lit(-(1 << 62)))).repartition(*group, "_cut")
    sizes = cut.groupBy(*group, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_cut").orderBy(F.col(by).asc_nulls_first(), *order)
    return (
        cut.withColumn("_at", F.row_number().over(inside))
        .join(starts, [*group, "_cut"])
        .withColumn(name, F.col("_start") + F.col("_at") - 1)
        .drop("_cut", "_at", "_start")
    )


def range_width(frame: DataFrame, by: str, rows: int = 1 << 16) -> int:
    """Values of `by` to a range so that a range holds about `rows` rows of evenly spread keys."""
    low, high, n = frame.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    if low is None:
        return 1
    return min(1 << 62, max(1, -(-(int(high) - int(low) + 1) * rows // max(1, n))))


def aside(documents: DataFrame, needed: tuple[str, ...], added: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`documents` with all but the `needed` columns under names that no operator uses, and what names them back.

    Naming back puts the columns in their old order, with `added` at the end; an old column of an added name is replaced.
    """
    names = {c: c if c in needed else f"_aside{i}" for i, c in enumerate(documents.columns)}
    new = {c.lower() for c in added}

    def back(frame: DataFrame) -> DataFrame:
        return frame.select(*(F.col(n).alias(c) for c, n in names.items() if c.lower() not in new), *added)

    return documents.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), back


def with_fields(frame: DataFrame, fields: str) -> StructType:
    """The schema of `frame` with more fields, given as DDL, at the end."""
    return StructType([*frame.schema.fields, *StructType.fromDDL(fields).fields])


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
