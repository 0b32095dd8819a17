"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from lodestone import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    query, sql = catalogue.QUERIES[name]
    found = query(spark, SF)
    columns = sorted(found.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())
    assert got == want


def test_filters_reach_the_scan(spark):
    plan = catalogue.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_custkey,10)" in plan and "LessThan(o_custkey,20)" in plan
    assert "o_orderdate" not in plan.split("ReadSchema")[1]
