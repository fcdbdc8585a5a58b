"""Every registered query of the library against its SQL twin in DuckDB."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest

from slopeline import plans

DATA = os.environ.get("SLOPELINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (pd.Timestamp, np.datetime64, datetime.datetime)):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows_of(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    if name in plans.ORACLES:
        assert rows_of(got) == rows_of(duck.execute(plans.ORACLES[name]).df())
    else:
        assert len(got)
