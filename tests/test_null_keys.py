"""Stock lines without a store or a product key count in every total."""

import os
import shutil
import sys

import pytest

from tests.conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import rows_of  # noqa: E402

TABLES = ("region", "nation", "supplier", "part")
AS_SQL = ("recon_detail", "customer_summary", "customer_rank", "store_summary", "store_rank", "detail_report",
          "detail_rank", "flag_counts", "payload_detail", "named_products", "book_pull_stats", "outlet_summary",
          "guard_listed_detail", "unmatched_stores", "unmatched_products", "unmatched_product_rank", "map_points",
          "recon_resolved_detail", "recon_resolved_customer", "recon_resolved_balance")


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    """(folder, DuckDB connection) of the small tables with null keys in some lines."""
    import duckdb

    d, con = str(tmp_path_factory.mktemp("nulls")), duckdb.connect()
    for t in TABLES:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", d)
    con.execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN (l_orderkey * 7 + l_linenumber) % 23 > 0 THEN l_suppkey END AS l_suppkey,
        CASE WHEN (l_orderkey * 3 + l_linenumber) % 19 > 0 THEN l_partkey END AS l_partkey)
        FROM '{SF_SMALL}/lineitem.parquet') TO '{d}/lineitem.parquet' (FORMAT parquet)""")
    for t in (*TABLES, "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, con


@pytest.mark.parametrize("name", AS_SQL)
def test_null_keys_match_the_oracle(spark, nulls, name):
    d, con = nulls
    df, cur = entry.queries()[name](spark, d), con.execute(entry.oracle_sql()[name])
    got = sorted(rows_of(df.columns, [tuple(r) for r in df.collect()]), key=repr)
    assert got == sorted(rows_of([c[0] for c in cur.description], cur.fetchall()), key=repr)


def test_customer_totals_hold_every_line(spark, nulls):
    d, con = nulls
    got = entry.queries()["customer_summary"](spark, d).collect()
    q = "CAST(trunc(l_quantity) AS BIGINT)"
    assert con.execute(f"""SELECT sum(CASE WHEN l_linestatus = 'F' THEN CASE l_returnflag WHEN 'R' THEN -{q} ELSE {q} END END),
        sum({q}) FILTER (l_returnflag = 'A'), sum({q}) FILTER (l_returnflag = 'N' AND l_linenumber <> 1)
        FROM lineitem""").fetchone() == tuple(sum(r[c] for r in got) for c in ("bojun_sum", "jd_sum", "mt_sum"))
    assert [r["store_cnt"] for r in got if r["customer_name"] is None] == [0]


def test_platform_balance_agrees_with_the_resolved_detail(spark, nulls):
    d, _ = nulls
    detail = entry.queries()["recon_resolved_detail"](spark, d).collect()
    balance = {r["platform"]: r for r in entry.queries()["recon_resolved_balance"](spark, d).collect()}
    lines = entry.queries()["customer_summary"](spark, d).collect()
    for platform, side in (("京东", "jd"), ("美团", "mt")):
        b = balance[platform]
        assert b["reconciled_qty"] == sum(r[f"{side}_qty"] or 0 for r in detail)
        assert b["total_qty"] == b["reconciled_qty"] + b["unmatched_qty"] == sum(r[f"{side}_sum"] for r in lines)
