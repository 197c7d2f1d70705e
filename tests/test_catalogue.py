"""Every registered query of the reference's own operators against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from verdigris.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE:
        assert columns
        return
    found = duck.sql(catalogue.ORACLE[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)
