"""Vectorised jobs that keep going: what fails on a row is told in that row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def with_errors(rows: DataFrame, key: str, job: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], fields: str) -> DataFrame:
    """(`key`, fields, error): `job` as `mapInPandas` takes it, on rows of which it may reject some. It must give rows with `key` and `fields` (DDL), any number for each row.

    A batch that raises is halved until single rows are left, so the others are still worked off together; a row that raises alone has nulls in `fields` and the
    error's type and text in `error`, which is null otherwise. Only errors in Python count: a lost executor is Spark's to repeat. Batches without rows give none.
    """
    key_type = rows.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in fields.split(", ")]

    def tried(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            found = pd.concat([pd.DataFrame({key: [], **{n: [] for n in names}}).astype(object), *job(iter([batch]))])
            yield found.assign(error=None)
        except Exception as e:
            if len(batch) > 1:
                half = len(batch) // 2
                yield from tried(batch.iloc[:half].reset_index(drop=True))
                yield from tried(batch.iloc[half:].reset_index(drop=True))
            else:
                yield pd.DataFrame({key: batch[key], **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                for found in tried(batch):
                    yield found[[key, *names, "error"]]

    return rows.mapInPandas(run, f"{key} {key_type}, {fields}, error string")
