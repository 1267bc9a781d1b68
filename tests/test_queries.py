"""Every query of the catalogue that has SQL equals it in DuckDB; the others run."""

import math

import duckdb
import pytest

from attestry.plans import archive, checks, exchange, records  # noqa: F401
from attestry.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    mine = sorted((tuple(same(r[c]) for c in columns) for r in rows), key=repr)
    other = sorted((tuple(same(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert mine == other
