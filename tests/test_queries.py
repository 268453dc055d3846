"""Every query with SQL gives the rows that DuckDB gives on the smallest test data."""

import decimal
import glob
import os

import pytest

from inkloom.plans import queries as Q

duckdb = pytest.importorskip("duckdb")


def _norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 5) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(small + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_rows(spark, small, duck, name):
    got = Q.QUERIES[name](spark, small)
    want = duck.execute(Q.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    cols = sorted(names)
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_rows_of_queries_without_sql(spark, small, name):
    got = Q.QUERIES[name](spark, small)
    rows = got.collect()
    assert len(rows) > 0 and all(any(v is not None for v in r) for r in rows) and len(set(map(str, rows))) == len(rows)
