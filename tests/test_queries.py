"""Every registered analytics query against its SQL in DuckDB on the smallest tables."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from tabulon.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "null" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.6g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def results(spark, sf):
    """Every query's rows, or what it raised; several run at a time."""

    def one(name):
        try:
            return name, QUERIES[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            return name, e

    with ThreadPoolExecutor(6) as pool:
        return dict(pool.map(one, sorted(QUERIES)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, db, name):
    got = results[name]
    if isinstance(got, Exception):
        raise got
    assert len(got) > 0 and len(got.columns) > 0
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got).equals(plain(want))
