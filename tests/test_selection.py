"""Splits and reports on small tables with gaps."""

import numpy as np
import pytest

from graphloom.operators import selection as sel
from graphloom.plans.queries import QUERIES


def test_splits(spark):
    rows = spark.range(2000).selectExpr("id", "cast(id % 3 as int) loop")
    first = {r["id"]: r for r in sel.splits(rows, "id").collect()}
    again = {r["id"]: r for r in sel.splits(rows.where("id % 2 = 0"), "id").collect()}
    assert all(first[i]["test"] == r["test"] for i, r in again.items())
    assert 300 < sum(r["test"] for r in first.values()) < 500 and 120 < sum(r["small_validation"] for r in first.values()) < 280
    assert not any(r["test"] and r["small_validation"] for r in first.values())
    assert {r["loop"] for r in first.values() if r["last_validation"]} == {2}
    assert sel.splits(rows.where("id < 0"), "id").count() == 0


def test_unit_rows(spark):
    rows = spark.createDataFrame([(1, 1.0, -3.0), (2, 0.0, 0.0), (3, None, 2.0)], "vec_id long, a double, b double")
    assert sorted(map(tuple, sel.unit_rows(rows, ["a", "b"]).collect())) == [(1, 0.25, -0.75), (2, 0.0, 0.0), (3, None, 1.0)]


def test_interpolated_curve(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.8), (1, 1, 0.7), (1, 0, 0.6), (2, 1, 0.5)], "loop int, y int, p double")
    found = {(r["loop"], r["x"]): r["recall"] for r in sel.interpolated_curve(rows, ["loop"], 4).collect()}
    assert found == {(1, 0.0): 0.5, (1, 0.25): 0.75, (1, 0.5): 1.0, (1, 0.75): 1.0, (1, 1.0): 1.0}


def test_selected_features_judges_all_components(spark, tmp_path):
    """Weak features count, and components behind the 64th."""
    rng = np.random.default_rng(3)
    y = np.arange(400) % 2
    x = rng.normal(size=(400, 70)) + np.outer(y, np.arange(70) % 7 / 20)
    spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(400)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    corr = {f"f{k}": np.corrcoef(x[:, k], y)[0, 1] for k in range(70)}
    order = sorted((f for f in corr if abs(corr[f]) >= 0.02), key=lambda f: -abs(corr[f]))
    assert any(abs(corr[f]) < 0.05 for f in order) and any(int(f[1:]) >= 64 for f in order)
    found = {r["place"]: (r["feature"], r["corr"]) for r in QUERIES["selected_features"](spark, str(tmp_path)).collect()}
    assert [found[k + 1][0] for k in range(len(found))] == order
    assert [found[k + 1][1] for k in range(len(found))] == pytest.approx([corr[f] for f in order], abs=1e-6)
