"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import numpy as np
import pytest

from gradus import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENTRIES = registry.entries()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        df[c] = df[c].map(lambda x: "null" if x is None or x != x else str(x)) if kind in "OTUb" else df[c].astype(float).round(5)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, oracle, name):
    got = ENTRIES[name].run(spark, SF).toPandas()
    if not ENTRIES[name].sql:
        assert len(got)
        return
    want = oracle.execute(ENTRIES[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], atol=1e-5, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
