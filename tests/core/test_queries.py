"""Every query with an oracle, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from voxlake.plans import queries as Q

SF = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, db, name):
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(Q.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=repr)
