"""Every registered query against its DuckDB SQL on the smallest data set, plus the entry smoke check."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tillroll.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return "NaN"
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=None)
        return v
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 13
    assert df.columns == ["sales_month", "monthly_orders", "monthly_revenue", "orders_growth_mom", "revenue_growth_mom"]


SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def test_column_types_match_oracle(spark, con):
    """Same type per column on both sides (counts BIGINT, money DOUBLE, no INTEGER or HUGEINT leaks)."""
    bad = []
    for name, fn in QUERIES.items():
        st = {f.name: f.dataType.simpleString() for f in fn(spark, SF).schema.fields}
        rel = con.sql(entry.oracle_sql()[name])
        dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
        bad += [(name, c, t, dt.get(c)) for c, t in st.items() if SPARK_TO_DUCK.get(t, t) != dt.get(c)]
    assert bad == []
