"""Every query with SQL against DuckDB on the same tables, values and row counts."""

import datetime
import decimal

import duckdb
import pytest

from lotsift.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLES[name])
    columns = [x[0] for x in cur.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
