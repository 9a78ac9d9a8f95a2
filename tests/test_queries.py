"""Registered graph queries against their SQL, run by DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import graphloom.plans.analysis_queries  # noqa: F401
import graphloom.plans.file_queries  # noqa: F401
import graphloom.plans.growth_queries  # noqa: F401
import graphloom.plans.kernel_queries  # noqa: F401
import graphloom.plans.mixed_queries  # noqa: F401
import graphloom.plans.model_queries  # noqa: F401
import graphloom.plans.score_queries  # noqa: F401
import graphloom.plans.search_queries  # noqa: F401
import graphloom.plans.selection_queries  # noqa: F401
import graphloom.plans.spectra_queries  # noqa: F401
import graphloom.plans.structure_queries  # noqa: F401
import graphloom.plans.table_queries  # noqa: F401
import graphloom.plans.topology_queries  # noqa: F401
from graphloom.plans.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def key(row):
    return tuple((x is not None, str(type(x)) if isinstance(x, str) else "", x if x is not None else 0) for x in row)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isclose(a, b, abs_tol=2e-6) or math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    if name not in ORACLE_SQL:
        assert found.count() > 0
        return
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    expected = sorted(cursor.fetchall(), key=key)
    assert sorted(found.columns) == sorted(names)
    rows = sorted((tuple(r) for r in found.select(*names).collect()), key=key)
    assert len(rows) == len(expected)
    wrong = [(a, b) for a, b in zip(rows, expected, strict=True) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]
