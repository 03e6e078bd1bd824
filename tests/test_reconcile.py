"""Flags, rollups and their invariants on literal frames."""

import pytest
from pyspark.sql import functions as F

from shelfcheck.contracts import (
    FLAG_DIFF, FLAG_NEG_BOOK, FLAG_ONLY_PLATFORM, FLAG_SAME, FLAG_UNLISTED, FLAG_VIRTUAL, FLAGS,
)
from shelfcheck.operators import reconcile as rc
from shelfcheck.operators import rollup as ru

SCHEMA = "store_key bigint, product_key bigint, bojun_qty bigint, jd_qty bigint, mt_qty bigint"


def lines(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture()
def stores(spark):
    return spark.createDataFrame(
        [(1, "S1", "C1", None, "j1", "m1"), (2, "S2", "C1", "闭店", "j2", "m2"),
         (3, "S3", "C2", None, "j3", None), (4, "S4", "C2", None, None, None)],
        "store_key bigint, store_name string, customer_name string, remark string, jd_id string, meituan_id string")


def test_one_flag_per_case(spark):
    data = [
        (1, 1, -3, 5, None),      # negative book
        (1, 2, None, 4, None),    # platform only
        (1, 3, 7, None, None),    # neither platform lists it
        (1, 4, 5, 95, None),      # virtual stock (>= 90)
        (1, 5, 5, 4, None),       # difference
        (1, 6, 5, 5, 5),          # all agree
        (1, 7, None, None, None),  # book null with both platforms null -> platform-only class
    ]
    det = rc.reconcile(lines(spark, data), virtual_threshold=90)
    got = {r["product_key"]: r["flag"] for r in det.collect()}
    assert got == {1: FLAG_NEG_BOOK, 2: FLAG_ONLY_PLATFORM, 3: FLAG_UNLISTED, 4: FLAG_VIRTUAL,
                   5: FLAG_DIFF, 6: FLAG_SAME, 7: FLAG_ONLY_PLATFORM}
    assert det.where(F.col("flag").isNull()).count() == 0


def test_lines_are_summed_and_diff_uses_zero_book(spark):
    data = [(1, 1, 2, None, None), (1, 1, 3, None, None), (1, 1, None, 4, None), (1, 1, None, 1, None),
            (1, 2, None, 6, None)]
    det = {r["product_key"]: r for r in rc.reconcile(lines(spark, data), 90).collect()}
    assert (det[1]["bojun_qty"], det[1]["jd_qty"], det[1]["mt_qty"]) == (5, 5, None)
    assert (det[1]["jd_diff"], det[1]["mt_diff"]) == (0, None)
    assert det[2]["jd_diff"] == 6


def test_stack_sides_and_name_fallback(spark):
    book = spark.createDataFrame([(1, 1, 3, None)], "store_key bigint, product_key bigint, qty bigint, name string")
    jd = spark.createDataFrame([(1, 1, 3, "jd-name"), (1, 2, 1, "jd-2")], "store_key bigint, product_key bigint, qty bigint, name string")
    mt = spark.createDataFrame([(1, 2, 1, "mt-2")], "store_key bigint, product_key bigint, qty bigint, name string")
    wide = rc.stack_sides({"book": book, "jd": jd, "mt": mt}, name="name")
    det = {r["product_key"]: r for r in rc.reconcile(wide, 90).collect()}
    assert det[1]["product_name"] == "jd-name"
    assert det[2]["product_name"] == "jd-2"
    assert det[1]["flag"] == FLAG_SAME


def test_flag_index_and_unknown_flag(spark):
    df = spark.createDataFrame([(f,) for f in FLAGS], "flag string")
    assert [r[0] for r in df.select(rc.flag_index()).collect()] == list(range(6))
    bad = spark.createDataFrame([("nope",)], "flag string")
    with pytest.raises(Exception):
        bad.select(rc.flag_index()).collect()


def test_rollup_totals_agree_across_levels(spark, stores):
    data = [(1, 1, 10, 8, 12), (1, 2, 4, 4, None), (2, 1, -2, 3, None), (3, 1, None, 5, 5),
            (3, 2, 6, 95, 1), (3, 3, 0, 0, 0), (4, 9, 5, None, None)]
    det = rc.reconcile(lines(spark, data), 90)
    srows = ru.store_level(det, stores)
    cust = {r["customer_name"]: r for r in ru.customer_summary(srows).collect()}
    stor = ru.store_summary(srows, stores).collect()
    for c in ("C1", "C2"):
        part = [r for r in stor if r["customer_name"] == c]
        for m in ("bojun_sum", "jd_sum", "mt_sum", "jd_diff", "mt_diff"):
            assert cust[c][m] == sum(r[m] for r in part), (c, m)
        assert cust[c]["store_cnt"] == len(part)
    named = rc.attach_dims(det, stores)
    total = named.agg(F.sum("bojun_qty")).first()[0]
    assert sum(r["bojun_sum"] for r in cust.values()) == total
    # Jd net diff over rows with book, not virtual: (8-10) + (4-4) + (3-(-2)) = 3
    assert cust["C1"]["jd_diff"] == 3
    # C1 jd rate: book > 0 and jd listed: least(8,10)+least(4,4) over 10+4 -> 85.7
    assert cust["C1"]["jd_rate"] == 85.7


def test_store_without_comparable_rows_rates_100(spark, stores):
    det = rc.reconcile(lines(spark, [(4, 9, 5, None, None)]), 90)
    r = ru.store_summary(ru.store_level(det, stores), stores).first()
    assert (r["jd_rate"], r["mt_rate"]) == (100.0, 100.0)


def test_store_ids_do_not_multiply_totals(spark):
    # A store with two dimension rows; ids are reduced to one row per name first.
    dims = spark.createDataFrame(
        [(1, "S1", "C1", None, "j1", "m1"), (5, "S1", "C1", None, "j9", None)],
        "store_key bigint, store_name string, customer_name string, remark string, jd_id string, meituan_id string")
    det = rc.reconcile(lines(spark, [(1, 1, 10, 8, None)]), 90)
    base = ru.store_level(det, dims)
    r = ru.store_summary(base, dims).collect()
    assert len(r) == 1 and r[0]["bojun_sum"] == 10 and r[0]["jd_id"] == "j9"


def test_inactive_count_counts_rows(spark, stores):
    assert ru.inactive_count(stores).first()[0] == 1
    extra = stores.unionByName(spark.createDataFrame(
        [(6, "S6", "C3", "机场店", None, None)], stores.schema))
    assert ru.inactive_count(extra).first()[0] == 2
