"""Every registered query with SQL equals DuckDB's result on the smallest tables, names and types included."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tesselune.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(map(str, r)) for r in cursor.fetchall()))
    assert sorted(columns) == sorted(df.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == {c[0]: str(c[1]) for c in cursor.description}
    got = sorted(tuple(map(str, r)) for r in df.select(columns).collect())
    assert got == want


def test_each_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)
