"""Every query with SQL gives the SQL's rows."""

import math
from pathlib import Path

import duckdb
import pytest
from conftest import SF, SF_SQL

from tideframe.plans import candidates, columns, context, files, indicators, market, outcomes, performance, registry, streams, swing  # noqa: F401


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(SF_SQL).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def same(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(v + 0.0, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, tables, name):
    got = registry.QUERIES[name](spark, SF_SQL)
    names = sorted(got.columns)
    want = tables.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(same(r[c]) for c in names) for r in got.collect()) == sorted(tuple(same(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
