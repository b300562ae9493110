"""Every registered query against its SQL on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import numpy as np
import pytest

from tidymesh.catalog import library_queries, model_queries, table_queries  # noqa: F401
from tidymesh.catalog.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float, decimal.Decimal)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    data = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name not in ORACLES:
        assert data
        return
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())
