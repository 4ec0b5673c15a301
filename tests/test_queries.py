"""Each query with SQL against DuckDB, and that the others run."""

import duckdb
import pytest

from statuta import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if sql := catalog.oracle_sql().get(name):
        found = con.sql(sql)
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert plain(rows) == plain(tuple(r[i] for i in at) for r in found.fetchall())
