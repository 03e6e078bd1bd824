"""Resolve, then reconcile: literal cases of J4 + J6 feeding J1, and the barcode key."""

from pyspark.sql import functions as F

from shelfcheck.contracts import FLAG_DIFF, FLAG_ONLY_PLATFORM, PLATFORM_JD, PLATFORM_MT
from shelfcheck.operators import match as mt
from shelfcheck.operators import resolve as rs

STORES = [(1, "S1", "C", "j1", "m1"), (2, "S2", "C", "j2", None)]


def stores(spark):
    return spark.createDataFrame(STORES, "store_key long, store_name string, customer_name string, jd_id string, meituan_id string")


def test_rows_resolve_or_stay_out(spark):
    st = stores(spark)
    aliases = spark.createDataFrame([("S2 depot", "S2")], "alias string, store_name string")
    book = spark.createDataFrame([("S1 ", "p1", 5), ("S2 depot", "p1", 3), ("nowhere", "p1", 9), (None, "p2", 1)],
                                 "warehouse string, product_code string, qty long")
    books = spark.createDataFrame([("p1", "690"), ("p2", None)], "product_code string, barcode string")
    platform = spark.createDataFrame(
        [(PLATFORM_JD, "p1", "j1", None, 4), (PLATFORM_JD, "own", "j2", "690", 7), (PLATFORM_JD, "own2", "j1", "111", 2),
         (PLATFORM_MT, "p2", "m1", None, 6), (PLATFORM_MT, "p1", "gone", None, 8), (PLATFORM_MT, "x", "m1", None, 1)],
        "platform string, platform_code string, store string, barcode string, qty long")
    maps = rs.mapping_tables(book, platform, st, aliases, books)
    assert {r["warehouse"]: r["store_key"] for r in maps["warehouse_mapping"].collect()} == {"S1 ": 1, "S2 depot": 2}
    b = rs.resolve_book(book, maps["warehouse_mapping"])
    p = rs.resolve_platform(platform, maps["platform_store_mapping"], maps["product_mapping"])
    got = {(r["store_key"], r["product_code"]): (r["bojun_qty"], r["jd_qty"], r["mt_qty"], r["flag"])
           for r in rs.reconcile_resolved(b, p, 90).collect()}
    assert got == {(1, "p1"): (5, 4, None, FLAG_DIFF), (2, "p1"): (3, 7, None, FLAG_DIFF), (1, "p2"): (None, None, 6, FLAG_ONLY_PLATFORM)}
    totals = {r["platform"]: tuple(r)[1:] for r in rs.balance(p).collect()}
    assert totals == {PLATFORM_JD: (13, 11, 2), PLATFORM_MT: (15, 6, 9)}


def test_each_row_meets_its_mapping_once(spark, tmp_dir):
    """The executed plan over written mappings: the book side has one join, the platform side one
    for products and one for stores; rows without a name or code lie in many tasks."""
    st = stores(spark)
    book = spark.range(2000).selectExpr("if(id % 3 = 0, null, concat('S', id % 4)) AS warehouse",
                                        "cast(id % 50 AS string) AS product_code", "id AS qty")
    platform = spark.range(2000).selectExpr(
        f"if(id % 2 = 0, '{PLATFORM_JD}', '{PLATFORM_MT}') AS platform",
        "if(id % 3 = 0, null, cast(id % 50 AS string)) AS platform_code", "if(id % 7 = 0, null, concat('j', id % 5)) AS store",
        "cast(null AS string) AS barcode", "id AS qty")
    books = spark.range(40).selectExpr("cast(id AS string) AS product_code", "cast(null AS string) AS barcode")
    maps = rs.write_mappings(spark, tmp_dir, rs.mapping_tables(book, platform, st, None, books), "1")

    def joins(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return plan.count("HashJoin") + plan.count("SortMergeJoin")

    assert joins(rs.resolve_book(book, maps["warehouse_mapping"])) == 1
    assert joins(rs.resolve_platform(platform, maps["platform_store_mapping"], maps["product_mapping"])) == 2
    assert joins(mt.unmatched_rows(platform, maps["product_mapping"])) == 1
    nowhere = platform.where("platform_code is null").select(mt.code_key().alias("k"))
    assert nowhere.where("k is null").count() == 0 and nowhere.distinct().count() == 6
    missed = mt.unmatched_rows(platform, maps["product_mapping"])
    assert missed.count() == platform.where("platform_code is null or cast(platform_code AS int) >= 40").count()


def test_null_barcodes_spread_and_never_match(spark):
    books = spark.createDataFrame([("p1", None), ("p2", "7")], "product_code string, barcode string")
    rows = spark.createDataFrame([(f"c{i}", f"s{i % 50}", None) for i in range(1000)] + [("c", "s", "7"), ("p1", "s", "7")],
                                 "platform_code string, store string, barcode string")
    out = mt.match_products(rows, books, "platform_code", use_barcode=True)
    assert out.count() == 1002
    assert sorted((r["platform_code"], r["matched_code"]) for r in out.where("matched_code is not null").collect()) == [
        ("c", "p2"), ("p1", "p1")]
    spread = rows.withColumn("_by_code", F.lit(None).cast("string")).select(mt._barcode_key("platform_code").alias("k"))
    assert spread.where("k is null").count() == 0 and spread.distinct().count() >= 1000


def test_changed_input_is_seen(spark, tmp_dir):
    """Nothing remembers a size or a listing: a table that grew at its path is read anew."""
    from shelfcheck.sources import testbind as tb

    path = f"{tmp_dir}/part.parquet"
    spark.range(5).selectExpr("id as p_partkey", "'n' as p_name").write.parquet(path)
    assert tb.products(spark, tmp_dir).count() == 5
    spark.range(100).selectExpr("id as p_partkey", "'n' as p_name").write.mode("append").parquet(path)
    assert tb.products(spark, tmp_dir).count() == 105
