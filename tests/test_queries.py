"""Every registered query with SQL equals that SQL in DuckDB; the rest return rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from quillmesh.plans import registry
from quillmesh.sources.catalog import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df):
    df = df.copy()
    for k in df.columns:
        if df[k].dtype == object:
            df[k] = df[k].map(lambda v: str(list(v)) if isinstance(v, list | tuple | np.ndarray) else v)
        if str(df[k].dtype).startswith("datetime"):
            df[k] = df[k].astype("datetime64[us]")
    cols = sorted(df.columns)
    return df[cols].sort_values(cols, key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = plain(registry.QUERIES[name](spark, SF).toPandas())
    if name not in registry.ORACLE_SQL:
        assert len(got.columns)
        return
    want = plain(duck.sql(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        same = (got[c].astype(object) == want[c].astype(object)) | (got[c].isna() & want[c].isna())
        assert same.all(), c


def test_names_need_no_session():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
