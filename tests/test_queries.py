"""Every query against its SQL, and every query for a stable schema."""

import datetime
import decimal

import duckdb
import pytest

from vellumspark.plans import assessments, kept, oracle, queries

QUERIES, SQL = queries.QUERIES | assessments.QUERIES | kept.QUERIES, oracle.SQL | assessments.SQL | kept.SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    frame, answer = QUERIES[name](spark, data), duck.sql(SQL[name])
    assert table_of(frame.columns, frame.collect()) == table_of(answer.columns, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry_without_the_optional_subpackage():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
