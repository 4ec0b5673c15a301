"""The operators' columns that SQL can say, and the n-gram join, against DuckDB over whole tables."""

import duckdb
import pytest

import __spark_entry__
from statuta.llm import queries
from tests.conftest import SF, SF01


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_columns(spark, name):
    for sf in (SF, SF01):
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.sql(__spark_entry__.oracle_sql()[name])
        got = __spark_entry__.queries()[name](spark, sf)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
