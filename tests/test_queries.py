"""Every query against its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from loomgraph import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    yield con
    con.close()


def plain(x):
    if isinstance(x, float | decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, datetime.datetime | datetime.date):
        return str(x)
    return repr(x)


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert bag([tuple(r) for r in got.collect()], got.columns) == bag(want.fetchall(), names)
