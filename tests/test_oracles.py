"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from skein import registry

NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(small):
    found = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        found.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return found


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(values):
    return sorted((tuple(map(norm, r)) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, con, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = rows(df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in registry.ORACLES:
        assert got
        return
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: NAMES.get(k, k) for c, k in df.dtypes} == kinds
    named = ", ".join(f'"{c}"' for c in columns)
    assert got == rows(con.sql(f"SELECT {named} FROM ({registry.ORACLES[name]}) q").fetchall())


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES and registry.FLAGSHIP in registry.ORACLES
