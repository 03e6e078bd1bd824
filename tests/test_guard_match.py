"""J8 / A6 / F4 (against a brute-force all-pairs fixture), J3-J7 matching."""

import itertools

from pyspark.sql import functions as F

from shelfcheck.contracts import GUARD_MET, GUARD_SHORT, PLATFORM_JD, PLATFORM_MT
from shelfcheck.operators import guard as gd
from shelfcheck.operators import match as mt


def guard_fixture(spark):
    jd = spark.createDataFrame(
        [("o1", "Out 1", "C1", "启用"), ("o2", "Out 2", "C1", "停用"), ("o3", "Out 3", "C2", "启用"),
         ("o4", "Out 4", None, "启用"), ("o5", "Out 5", "C1", None)],
        "store_code string, store_name string, dealer string, store_status string")
    mtl = spark.createDataFrame([("m1", "Mt 1", "C1", "营业中")],
                                "store_id string, store_name string, dealer string, business_status string")
    outlets = gd.live_outlets(jd, mtl)
    products = spark.createDataFrame(
        [("C1", "p1", 10), ("C1", "p2", 0), ("C1", "p3", -2), ("C1", "p4", 5), ("C2", "p1", 3)],
        "customer_name string, product_code string, offline_qty bigint")
    jd_stock = spark.createDataFrame(
        [("o1", "p1", 12), ("o1", "p2", None), ("o1", "p9", 4), ("o1", "p4", 2), ("o3", "p1", 1)],
        "store_code string, product_code string, qty bigint")
    mt_stock = spark.createDataFrame([("m1", "p4", 5), ("m1", "p4", 1)],
                                     "store_id string, product_code string, qty bigint")
    return outlets, gd.outlet_stock(jd_stock, mt_stock), products


def brute_force(outlets, stock, products):
    """The definition, literally: every live outlet x every product of its dealer."""
    s = {(r["platform"], r["outlet_code"], r["product_code"]): r["outlet_qty"] for r in stock.collect()}
    prods = products.collect()
    out = {}
    for o, p in itertools.product(outlets.collect(), prods):
        if o["customer_name"] != p["customer_name"]:
            continue
        q = s.get((o["platform"], o["outlet_code"], p["product_code"]))
        gap = (q or 0) - p["offline_qty"]
        key = (o["platform"], o["outlet_code"])
        cnt, ok = out.get(key, (0, 0))
        out[key] = (cnt + 1, ok + (gap >= 0))
    return out


def test_live_outlets(spark):
    outlets, _, _ = guard_fixture(spark)
    got = sorted((r["platform"], r["outlet_code"]) for r in outlets.collect())
    assert got == sorted([(PLATFORM_JD, "o1"), (PLATFORM_JD, "o3"), (PLATFORM_MT, "m1")])


def test_summary_matches_all_pairs(spark):
    outlets, stock, products = guard_fixture(spark)
    summ = {(r["platform"], r["outlet_code"]): r for r in gd.outlet_summary(outlets, stock, products).collect()}
    want = brute_force(outlets, stock, products)
    assert set(summ) == set(want)
    for k, (cnt, ok) in want.items():
        r = summ[k]
        assert (r["product_cnt"], r["ok_cnt"], r["bad_cnt"]) == (cnt, ok, cnt - ok), k
        assert r["ok_cnt"] + r["bad_cnt"] == r["product_cnt"]
    # o1: p1 ok (12>=10), p2 ok (null->0 >= 0), p3 ok (unlisted, -2), p4 short (2<5) -> 75.0
    assert summ[(PLATFORM_JD, "o1")]["ok_rate"] == 75.0


def test_outlet_detail_lists_unlisted_products_short_first(spark):
    _, stock, products = guard_fixture(spark)
    chosen = spark.createDataFrame([("C1", PLATFORM_MT, "m1")], "customer_name string, platform string, outlet_code string")
    rows = gd.outlet_detail(chosen, stock, products).collect()
    by = {r["product_code"]: r for r in rows}
    assert by["p4"]["outlet_qty"] == 6 and by["p4"]["is_ok"] is True
    assert by["p1"]["outlet_qty"] is None and by["p1"]["gap"] == -10 and by["p1"]["is_ok"] is False
    assert rows[0]["is_ok"] is False  # short first
    assert len(rows) == 4


def test_listed_detail_status(spark):
    outlets, stock, products = guard_fixture(spark)
    rows = gd.listed_detail(outlets, stock, products).collect()
    st = {(r["outlet_code"], r["product_code"]): r["status"] for r in rows}
    assert st[("o1", "p1")] == GUARD_MET and st[("o1", "p4")] == GUARD_SHORT
    assert ("o1", "p9") not in st  # not a product of the dealer


def test_address_book_first_non_blank_in_order(spark):
    src = spark.createDataFrame(
        [("店A", "  ", 1), ("店A", "addr-2", 2), ("店A", "addr-3", 3), ("　店B　", "b-1", 4), (None, "x", 5)],
        "name string, address string, line_no int")
    book = mt.address_book(src)
    stores = spark.createDataFrame([("店A",), ("店B",), ("店C",)], "store_name string")
    got = {r["store_name"]: r["store_address"] for r in mt.lookup_address(stores, book).collect()}
    assert got == {"店A": "addr-2", "店B": "b-1", "店C": None}
    hits, missing = mt.address_match_report(stores, book)
    assert hits.first()[0] == 2 and [r[0] for r in missing.collect()] == ["店C"]
    assert mt.address_match_report(stores, None) == (None, None)


def test_unmatched_stores_with_alias_and_code(spark):
    stores = spark.createDataFrame(
        [("Alpha", "101", None, "P", "X", "j1", "m1"), ("Beta", "102", None, "P", "Y", "j2", None),
         ("Gamma", "103", "闭店", "P", "Z", None, None), ("Delta", "104", None, "Q", "W", None, None)],
        "store_name string, internal_code string, remark string, province string, city string, jd_id string, meituan_id string")
    wh = spark.createDataFrame([("Alpha", "101"), ("Bee", "102"), ("Old Delta", "104")],
                               "warehouse string, store_code string")
    aliases = spark.createDataFrame([("Bee", "Beta")], "alias string, store_name string")
    got = mt.unmatched_stores(stores, wh, aliases).collect()
    assert [(r["store_name"], r["bojun_warehouse"]) for r in got] == [("Delta", "Old Delta")]
    got2 = mt.unmatched_stores(stores, wh).collect()
    assert [(r["store_name"], r["bojun_warehouse"]) for r in got2] == [("Beta", "Bee"), ("Delta", "Old Delta")]


def test_match_products_barcode_fallback_and_unmatched(spark):
    book = spark.createDataFrame([("A1", "690001"), ("A2", "690002"), ("A3", "690002")],
                                 "product_code string, barcode string")
    rows = spark.createDataFrame(
        [(PLATFORM_JD, "A1", "s1", "n1", None, 3), (PLATFORM_JD, "zz", "s1", "n2", "690002", 4),
         (PLATFORM_JD, "q1", "s1", "n3", "999", 5), (PLATFORM_JD, "q1", "s2", "n3", "999", 1),
         (PLATFORM_JD, "q1", "s2", "n3", "999", 1)],
        "platform string, platform_code string, store string, product_name string, barcode string, qty bigint")
    matched = mt.match_products(rows, book, "platform_code", use_barcode=True)
    assert matched.count() == 5  # barcode side made unique first: no fan-out
    got = {r["platform_code"]: r["matched_code"] for r in matched.collect()}
    assert got["A1"] == "A1" and got["zz"] == "A3" and got["q1"] is None
    un = mt.unmatched_products(matched).collect()
    assert [(r["platform_code"], r["store_cnt"], r["total_qty"]) for r in un] == [("q1", 2, 7)]


def test_bound_aliases_resolve_renamed_warehouses(spark):
    """Binding check (sf0.01): the alias table takes part of the renamed warehouses out
    of the unmatched list, so J4's alias path carries rows in the registered query."""
    from shelfcheck.operators import rollup as ru
    from shelfcheck.plans import queries as Q
    from shelfcheck.sources import testbind as tb
    from tests.conftest import SF_CHECK

    st = tb.stores(spark, SF_CHECK)
    wh = tb.book_warehouses(ru.store_partials(Q.keyed_detail(spark, SF_CHECK)), st)
    aliases = tb.store_aliases(spark, SF_CHECK)
    with_alias = {r["store_name"] for r in mt.unmatched_stores(st, wh, aliases).collect()}
    without = {r["store_name"] for r in mt.unmatched_stores(st, wh).collect()}
    via_alias = {r["store_name"] for r in aliases.collect()}
    assert with_alias and via_alias and with_alias < without
    assert without - with_alias == via_alias


def test_bound_barcodes_match_promo_codes(spark):
    """Binding check (sf0.01): PROMO listings match only through the barcode fallback
    (J6); orphan codes stay unmatched either way (J7)."""
    from shelfcheck.plans import queries as Q
    from shelfcheck.sources import testbind as tb
    from tests.conftest import SF_CHECK

    det = Q.keyed_detail(spark, SF_CHECK)
    codes = tb.product_codes(spark, SF_CHECK)
    rows, book = tb.platform_rows(det, codes), tb.book_products(det)

    def unmatched(use_barcode):
        m = mt.match_products(rows, book, "platform_code", use_barcode)
        return {r["platform_code"] for r in m.where(F.col("matched_code").isNull())
                .select("platform_code").distinct().collect()}

    with_bc, without_bc = unmatched(True), unmatched(False)
    promo = {r["c"] for r in codes.where(F.col("jd_barcode").isNotNull()).select(F.col("jd_code").alias("c"))
             .unionByName(codes.where(F.col("jd_barcode").isNotNull()).select(F.col("mt_code").alias("c")))
             .collect()}
    assert with_bc and with_bc < without_bc
    assert without_bc - with_bc <= promo and not (with_bc & promo)
