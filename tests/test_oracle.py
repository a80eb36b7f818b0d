"""Every query of the library proper against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import evidence, fits, gates, sources, space, studies, summaries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {q.__name__: q for part in (space, evidence, studies, summaries, sources, gates, fits) for q in part.QUERIES}
SQL = {**space.ORACLE, **evidence.ORACLE, **studies.ORACLE, **summaries.ORACLE, **sources.ORACLE, **gates.ORACLE, **fits.ORACLE}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def settled(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else str(x)) if df[c].dtype == object else df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = settled(QUERIES[name](spark, SF).toPandas()), settled(duck.sql(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
