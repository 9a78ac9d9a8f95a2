"""A training-data pipeline over `documents`, in stages that each call one corpus operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, table, written
from graphloom.llm.decontam import decontaminate
from graphloom.llm.jaccard import keep_one_of_each
from graphloom.llm.linededup import dedup_lines
from graphloom.llm.packing import pack_documents
from graphloom.llm.quality import keep_quality
from graphloom.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage, with texts going to Python workers in small batches: all stages share the executors' memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels` of these texts, doesn't reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), docs)


@bounded
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less their repeated lines; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(docs.columns)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles with a Jaccard similarity of 0.8 or more join."""
    return keep_one_of_each(docs, words=5, percent=80)


@bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold passages of `benchmark`."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@bounded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 1024."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: The classifier can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
