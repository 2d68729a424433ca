"""Every registered report against its DuckDB oracle SQL on the sf0.001 tables (the driver's check)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES = {name: q for name, q in E.queries().items() if name in E.registry.REPORTS or name in E.registry.KEPT}
SQL = {name: q for name, q in E.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def norm(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL) and len(QUERIES) == 69 + 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    dorder = [dcols.index(cols[i]) for i in order]
    s = sorted((tuple(norm(r[i]) for i in order) for r in srows), key=repr)
    d = sorted((tuple(norm(r[i]) for i in dorder) for r in drows), key=repr)
    assert s == d


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "total_people" in df.columns
