"""Every registered query of the reference's own operators against its SQL counterpart."""

import os

import duckdb
import pytest

from seqloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    mine, sql = registry.QUERIES[name](spark, DATA).toPandas(), db.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(sql.columns)
    assert sorted(mine.columns) == cols
    mine, sql = (sorted(map(tuple, x[cols].astype(str).to_numpy().tolist())) for x in (mine, sql))
    assert mine == sql


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
