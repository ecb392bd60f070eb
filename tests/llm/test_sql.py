"""The operators' queries against their SQL twins."""

import os

import duckdb
import pytest

from quarry.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_with_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    found = duck.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert sorted(found.columns) == order
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    at = [found.columns.index(c) for c in order]
    assert got and got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
