"""Wide features: all components of the vectors take part."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import preparation as prep
from graphloom.plans import model_queries


def test_all_components(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    frame = prep.wide_features(vectors)
    names = prep.feature_names(frame)
    assert names == [f"f{k}" for k in range(64)]
    x = np.array([r["embedding"] for r in vectors.collect()], float)
    found = {r["feature"]: r for r in prep.feature_statistics(frame, names, "y").collect()}
    assert np.allclose([found[c]["mean"] for c in names], x.mean(0)) and np.allclose([found[c]["std"] for c in names], x.std(0))


def test_short_and_no_vectors(spark):
    vectors = spark.createDataFrame([(1, 0, [1.0]), (2, 1, [2.0, 3.0]), (3, 1, None)], "vec_id long, label int, embedding array<float>")
    assert [(r["f0"], r["f1"]) for r in prep.wide_features(vectors).orderBy("vec_id").collect()] == [(1.0, None), (2.0, 3.0), (None, None)]
    assert prep.feature_names(prep.wide_features(vectors.where(F.lit(False)))) == []


def test_models_take_all_features(spark, sf):
    assert {r["feature"] for r in model_queries.feature_importances(spark, sf).collect()} == {f"f{k}" for k in range(64)}
