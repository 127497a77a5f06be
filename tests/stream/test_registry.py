"""Each registered query against its SQL, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from tests.conftest import SF
from tideflow.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, database, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect())
    want = database.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[k]) for k in order) for r in want.fetchall())


def test_driver_contract(spark):
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert driver.entry(spark).count() > 0


def test_the_chain_runs_over_every_event(spark):
    """One row for each event whose doubled square passes the filter; the ten-row golden covers the example."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = {(r.side, r.t0, r.v) for r in catalogue.QUERIES["full_pipeline"](spark, SF).collect()}
    ids = [r.event_id for r in events.select("event_id").collect()]
    assert len(ids) > 10 and got == {("left" if 2 * i * i < 50 else "right", i, 2 * i * i) for i in ids if 2 * i * i > 10}
