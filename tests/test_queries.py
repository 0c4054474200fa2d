"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lightfold.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def value(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if hasattr(x, "item"):
        return value(x.item())
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(value(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns)
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
