"""Every registered query against its DuckDB oracle on the small test tables."""

import os
import sys

import pytest

from tests.conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, rows_of  # noqa: E402
from shelfcheck.plans.queries import REGISTRY  # noqa: E402

SKIP = {"login_profiles_stream"}  # covered by test_streaming (slow stream start-up)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SKIP))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cur = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    a = sorted(rows_of(df.columns, [tuple(r) for r in df.collect()]), key=repr)
    b = sorted(rows_of(dcols, cur.fetchall()), key=repr)
    assert a == b


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "customer_name"
