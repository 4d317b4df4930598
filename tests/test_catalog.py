"""Every SQL twin against its query at the smallest size."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"create view {t[:-8]} as select * from '{DIR}/{t}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: df[c].astype(float).round(5) + 0.0 if pd.api.types.is_numeric_dtype(df[c]) else df[c].astype(str) for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    ours, theirs = plain(entry.queries()[name](spark, DIR).toPandas()), plain(db.sql(entry.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours.columns:
        if ours[c].dtype == float:
            assert np.allclose(ours[c], theirs[c], atol=2e-5, equal_nan=True), c
        else:
            assert (ours[c] == theirs[c]).all(), c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
