"""Every query with an oracle gives the oracle's rows on the smallest tables; the others run."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from bourselake.plans import all_queries  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries.queries(), all_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def _row(r, order):
    return tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        mine, theirs = (sorted(range(len(c)), key=lambda i, c=c: c[i]) for c in (df.columns, want.columns))
        assert sorted(_row(r, mine) for r in got) == sorted(_row(r, theirs) for r in want.fetchall())
