"""Driver contract: the smoke entry, and every registered query against its
DuckDB oracle on the smallest test tables."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from quarry.sources.tables import TABLES

SMALL = "/root/testdata/sf0.001"
ROWS_ONLY = {"logistic_auc"}


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["token", "count", "max_count"]
    rows = df.collect()
    assert rows and all(r["count"] == r.max_count for r in rows)


def test_registry_complete():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {n for n in set(q) - set(o) if n != "pipeline" and not re.match(r"op\d+_", n)} == ROWS_ONLY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    idx = [cols.index(c) for c in df.columns]
    want = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    assert _norm(got) == _norm(want)
