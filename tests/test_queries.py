"""Every query of the catalog against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from wavelark.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if not isinstance(v, (list, tuple, dict)) and np.ndim(v) == 0 and pd.isna(v):
            return "null"
        if "date" in type(v).__name__.lower() or isinstance(v, pd.Timestamp):
            return str(pd.Timestamp(v))
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(float(v))
        return str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(one(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        assert plain(got) == plain(duck.sql(catalog.ORACLES[name]).df())
    else:
        # values are checked in test_models.py and test_sources.py
        assert len(got) and len(got.columns)
