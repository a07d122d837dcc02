"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarry import catalog

DATA = "/root/testdata/sf0.001"


def _value(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 6)
    return str(v)


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(_value, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = _rows(got), _rows(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
