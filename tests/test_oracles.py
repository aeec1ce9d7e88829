"""Every query with DuckDB SQL gives the SQL's rows; every query runs."""

import math
import os

import duckdb
import pytest

from pairloom.plans import study

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return repr([cell(x) for x in v])
    if hasattr(v, "is_finite") or isinstance(v, (int, float)):
        return repr(round(float(v), 6))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(study.QUERIES))
def test_query(spark, duck, name):
    df = study.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted("|".join(cell(r[c]) for c in columns) for r in df.collect())
    if name in study.ORACLES:
        rel = duck.sql(study.ORACLES[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert mine == sorted("|".join(cell(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert mine


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
