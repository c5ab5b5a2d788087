"""Every registered query of the core runs; where there is SQL, DuckDB gives the same rows."""

import glob
import math
import os

import duckdb
import pytest

from quern.plans import registry


def plain(v):
    if v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in registry.ORACLES:
        assert rows
        return
    got = duck.execute(registry.ORACLES[name])
    named = [d[0] for d in got.description]
    order = sorted(range(len(named)), key=lambda i: named[i])
    assert sorted(named) == columns
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())
