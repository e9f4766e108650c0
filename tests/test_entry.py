"""The driver's contract: every registered query runs, and those with SQL agree with DuckDB."""

import math
import os

import pytest

import __spark_entry__
from brinewood.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)
    sql = catalog.ORACLES.get(name)
    if sql:
        rel = duck.sql(sql)
        names = [c[0] for c in rel.description]
        at = [names.index(c) for c in df.columns]
        assert len(names) == len(at)
        assert found == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
