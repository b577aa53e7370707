"""Every registered query against its oracle SQL in DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from bazaarflow.plans.bindings import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    return repr(v) if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    expected = oracle.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in rows)
    order = [list(expected.columns).index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in expected.fetchall())
