"""Every registered query against its DuckDB SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from pairsignals.plans.catalog import QUERIES  # noqa: E402
from pairsignals.plans.oracle import ORACLE_SQL  # noqa: E402
from pairsignals.sources.tables import TABLES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    s_cols, s_hash, s_lines = digest(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[key])
    o_cols, o_hash, o_lines = digest([d[0] for d in res.description], res.fetchall())
    assert s_cols == o_cols
    assert len(s_lines) == len(o_lines)
    assert s_hash == o_hash, (sorted(set(s_lines) - set(o_lines))[:3], sorted(set(o_lines) - set(s_lines))[:3])


def test_entry_is_the_verdict_table(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 90  # 10 eligible tickers, both orders
    assert {r["verdict"] for r in rows} <= {"cointegrated", "not_cointegrated", "tradeable"}
