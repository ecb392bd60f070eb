"""Every query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans.catalog import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(float(r[i]) if type(r[i]).__name__ in ("Decimal", "float") else r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    fn, sql = QUERIES[name]
    df = fn(spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    if not sql:
        assert df.columns
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    assert got == plain(found.fetchall(), found.columns)


def test_histogram_has_all_problems(spark, tmp_path):
    rows = [(1, "R")] * 40 + [(2, "R")] * 14 + [(2, "N")] + [(3, "N")] + [(4, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["n_correct"]: r["n"] for r in QUERIES["correct_histogram"][0](spark, str(tmp_path)).collect()}
    assert got == {k: int(k in (0, 1, 14, 40)) for k in range(41)}
