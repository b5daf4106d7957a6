"""Every query with SQL against DuckDB on the smallest tables: columns, rows and values."""

import decimal
import math
import os

import pytest

import __spark_entry__ as entry
from quarry import plans

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.ORACLES) <= set(plans.PLANS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_rows_match_duckdb(spark, duck, name):
    df, want = plans.PLANS[name](spark, SF), duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(plans.PLANS) - set(plans.ORACLES)))
def test_queries_without_sql_give_rows(spark, name):
    assert plans.PLANS[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_recall_of_cells_is_measured_for_every_query(spark):
    row = plans.PLANS["evl_5_recall_of_cells"](spark, SF).first()
    assert (row["recall"], row["least"], row["recalled"]) == (1.0, 1.0, True)
