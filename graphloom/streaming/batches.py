"""File streams worked off in batches that survive restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run_available(spark: SparkSession, source: str, schema: StructType, work: Callable[[DataFrame], DataFrame], target: str, key: str, files: int = 1, keep_going: bool = False) -> None:
    """Applies `work` to all Parquet files in `source` that no earlier run has taken, `files` to a batch.

    target/rows/batch_id=n holds a batch's result, target/manifest/batch_id=n its row count and key range, and
    target/errors/batch_id=n its rows without a key, which `work` doesn't get. The checkpoint is in target/checkpoint: a
    later run goes on where this one ended. A batch that is repeated after a failure replaces what it wrote.

    With `keep_going`, a batch on which `work` fails leaves a row in target/failures/batch_id=n (n_rows, first_key, last_key, error) and nothing in rows, and the stream
    goes on; without, it stops there, and the next run tries that batch again.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.where(F.col(key).isNull()).write.mode("overwrite").parquet(f"{target}/errors/batch_id={number}")
        try:
            work(batch.where(F.col(key).isNotNull())).write.mode("overwrite").parquet(f"{target}/rows/batch_id={number}")
        except Exception as e:
            if not keep_going:
                raise
            told = f"{type(e).__name__}: {e}"[:2000]
            failed = batch.agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.lit(told).alias("error"))
            failed.write.mode("overwrite").parquet(f"{target}/failures/batch_id={number}")
            return
        rows = batch.agg(F.count(F.lit(1)).alias("n_rows"), F.count(key).alias("n_good"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
        rows.write.mode("overwrite").parquet(f"{target}/manifest/batch_id={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
