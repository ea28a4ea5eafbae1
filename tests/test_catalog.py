"""Every registered query against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from lithoframe.plans import catalog

from conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return ""
        return repr(float(v)) if isinstance(v, (float, np.floating)) else str(int(v)) if isinstance(v, (bool, np.bool_, int, np.integer)) else str(v)

    return sorted(map(tuple, df[sorted(df.columns)].map(one).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got) or name in ("nearest_gr", "match_shift", "xcorr")  # the typewell is out of reach in the smallest tables
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["well", "row_idx", "TVT_input"] and len(df.columns) == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
