"""Jobs and streams that go on after a failure."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.operators.guarded import with_errors
from graphloom.streaming.batches import run_available


def test_bad_rows_tell_their_error(spark):
    rows = spark.range(500).select(F.col("id").alias("graph_id"), F.when(F.col("id") % 100 == 7, None).otherwise(F.col("id") + 1).alias("x")).repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def job(batches):
        for b in batches:
            seen.add(1)
            if b["x"].isna().any():
                raise ValueError("no x")
            yield pd.DataFrame({"graph_id": b["graph_id"], "double": (2 * b["x"]).astype("int64")})
            yield pd.DataFrame({"graph_id": b["graph_id"], "double": (3 * b["x"]).astype("int64")})

    found = with_errors(rows, "graph_id", job, "double long").collect()
    assert {r["graph_id"]: r["error"] for r in found if r["error"]} == {k: "ValueError: no x" for k in (7, 107, 207, 307, 407)}
    assert sorted(r["double"] for r in found if r["double"] is not None) == sorted(m * (k + 1) for k in range(500) if k % 100 != 7 for m in (2, 3))
    assert seen.value < 150
    assert with_errors(rows.limit(0), "graph_id", job, "double long").collect() == []


def test_stream_goes_on_after_a_bad_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)
    schema = spark.range(1).schema
    work = lambda batch: batch.withColumn("y", F.when(F.col("id") == 15, F.raise_error(F.lit("bad row")).cast("int")).otherwise(1))
    run_available(spark, source, schema, work, target, "id", keep_going=True)
    failures = spark.read.parquet(f"{target}/failures").collect()
    assert [(r["n_rows"], r["first_key"], r["last_key"]) for r in failures] == [(10, 10, 19)] and "bad row" in failures[0]["error"]
    rows = spark.read.parquet(f"{target}/manifest")
    assert rows.agg(F.sum("n_rows")).first()[0] == 30
    good = [r["batch_id"] for r in rows.collect()]
    assert sorted(r["id"] for k in good for r in spark.read.parquet(f"{target}/rows/batch_id={k}").collect()) == [x for x in range(40) if not 10 <= x < 20]
    with pytest.raises(Exception, match="bad row"):
        run_available(spark, source, schema, work, str(tmp_path / "again"), "id")
