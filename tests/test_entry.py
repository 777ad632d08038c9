"""Driver contract and the oracle gate at sf0.001 (every registered query
against its DuckDB SQL: row count, column names, order-insensitive values)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from platelens.plans.registry import QUERIES, ROWS_ONLY

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    return repr(round(v, 9)) if isinstance(v, float) and not math.isnan(v) else repr(v)


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t + '.parquet')}')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["restaurant", "item", "item_gr", "max_calories", "rank", "label", "label_short"]


def test_every_query_has_oracle_or_is_rows_only():
    q, s = E.queries(), E.oracle_sql()
    assert set(QUERIES) <= set(q) and set(s) <= set(q)
    assert set(QUERIES) - set(s) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))   # the text queries have tests of their own
def test_query_against_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    rel = con.sql(sql)
    orows, ocols = rel.fetchall(), rel.columns
    assert sorted(df.columns) == sorted(ocols)
    to_duck = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {n: to_duck.get(t, t) for n, t in df.dtypes} == {n: str(t).upper() for n, t in zip(ocols, rel.types)}
    assert len(rows) == len(orows)
    assert _bag(rows, df.columns) == _bag(orows, ocols)
