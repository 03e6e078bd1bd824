"""Binding of the shared test tables to the reconciliation roles.

customer (dealer) = nation of the supplier, store / outlet = supplier, product = part,
book / jd / mt stock = classes of lineitem rows, logins = events. Every frame here is
derived by Spark from the given parquet tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.contracts import (
    INACTIVE_REMARKS,
    JD_LIVE_STORE_STATUS,
    MT_LIVE_BUSINESS_STATUS,
    PLATFORM_JD,
    PLATFORM_MT,
)

VIRTUAL_THRESHOLD = 90

# Non-live outlet states used by the binding (any value other than the live one works).
JD_DISABLED = "停用"
MT_RESTING = "休息中"


class TableFolder(str):
    """The folder of the tables for the length of one query: a table's schema is read from its
    footer once, however often the query reads the table. Files are listed for every read."""

    def __init__(self, path: str):
        self.schemas: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table."""
    path = f"{sf_dir}/{name}.parquet"
    if not isinstance(sf_dir, TableFolder):
        return spark.read.parquet(path)
    if name not in sf_dir.schemas:
        sf_dir.schemas[name] = spark.read.parquet(path).schema
    return spark.read.schema(sf_dir.schemas[name]).parquet(path)


def stock_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of lineitem -> the wide line form of all three stock sides.

    book: linestatus F, negative for returns (R); jd: returnflag A;
    mt: returnflag N and linenumber <> 1. Lines in none of the three are filtered by a
    predicate on raw columns, which reaches the parquet reader. Lines without a store or a
    product stay: they count in the sums.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    status, rflag = F.col("l_linestatus"), F.col("l_returnflag")
    in_book = status == "F"
    in_jd = rflag == "A"
    in_mt = (rflag == "N") & (F.col("l_linenumber") != 1)
    q = F.col("l_quantity").cast("bigint")
    return li.where(in_book | in_jd | in_mt).select(
        F.col("l_suppkey").alias("store_key"),
        F.col("l_partkey").alias("product_key"),
        F.when(in_book, F.when(rflag == "R", -q).otherwise(q)).alias("bojun_qty"),
        F.when(in_jd, q).alias("jd_qty"),
        F.when(in_mt, q).alias("mt_qty"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store mapping (v_dim_store shape): one row per supplier.

    A supplier with a negative balance is a closed store; jd / mt ids are the
    supplier key rendered per platform.
    """
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    r = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, F.col("n_regionkey") == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("store_key"),
            F.col("s_name").alias("store_name"),
            F.col("n_name").alias("customer_name"),
            F.col("r_name").alias("province"),
            F.col("n_name").alias("city"),
            F.when(F.col("s_acctbal") < 0, F.lit(INACTIVE_REMARKS[0])).alias("remark"),
            F.col("s_suppkey").cast("string").alias("internal_code"),
            F.col("s_suppkey").cast("string").alias("jd_id"),
            F.concat(F.lit("mt"), F.col("s_suppkey").cast("string")).alias("meituan_id"),
            F.concat(F.col("r_name"), F.lit(" "), F.col("n_name"), F.lit(" "),
                     F.col("s_name")).alias("store_address"),
            F.col("s_acctbal").alias("balance"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_key"), F.col("p_name").alias("product_name")
    )


def jd_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jd outlet list: each supplier is an outlet of its dealer; live unless in debt."""
    st = stores(spark, sf_dir)
    return st.select(
        F.col("jd_id").alias("store_code"),
        "store_name",
        F.col("customer_name").alias("dealer"),
        F.col("city"),
        "store_address",
        F.when(F.col("balance") >= 0, F.lit(JD_LIVE_STORE_STATUS))
        .otherwise(F.lit(JD_DISABLED)).alias("store_status"),
    )


def mt_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mt outlet list, same shape rule as jd with mt ids."""
    st = stores(spark, sf_dir)
    return st.select(
        F.col("meituan_id").alias("store_id"),
        "store_name",
        F.col("customer_name").alias("dealer"),
        F.col("city"),
        "store_address",
        F.when(F.col("balance") >= 0, F.lit(MT_LIVE_BUSINESS_STATUS))
        .otherwise(F.lit(MT_RESTING)).alias("business_status"),
    )


# Warehouse-name rule of the binding. The book system names most warehouses exactly as
# the store mapping does; for stores with a balance in [RENAMED_FROM, RENAMED_TO) it
# appends WAREHOUSE_SUFFIX, and the alias table knows that form only for balances in
# [RENAMED_FROM, ALIASED_TO). So some active stores resolve through an alias (J4) and
# the rest of the renamed ones stay unmatched.
WAREHOUSE_SUFFIX = "仓"
RENAMED_FROM, ALIASED_TO, RENAMED_TO = 1000, 1500, 2000


def _renamed(balance: str = "balance"):
    b = F.col(balance)
    return (b >= RENAMED_FROM) & (b < RENAMED_TO)


def _warehouse_name():
    return F.when(_renamed(), F.concat("store_name", F.lit(WAREHOUSE_SUFFIX))).otherwise(F.col("store_name"))


def book_warehouses(store_parts: DataFrame, stores_df: DataFrame) -> DataFrame:
    """Warehouse names (and codes) the book side reports: stores with book stock.

    ``store_parts``: per-store partial sums (``rollup.store_partials``); a store has book
    stock when its summed book quantity is not null. One row per store, so the frame is
    bounded by the store dimension.
    """
    wh = store_parts.where(F.col("bojun_raw").isNotNull()).select("store_key")
    return wh.join(stores_df, "store_key").select(
        _warehouse_name().alias("warehouse"),
        F.col("internal_code").alias("store_code"))


def store_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store alias table (alias -> store_name) for part of the renamed warehouses."""
    st = stores(spark, sf_dir)
    b = F.col("balance")
    return st.where((b >= RENAMED_FROM) & (b < ALIASED_TO)).select(
        F.concat("store_name", F.lit(WAREHOUSE_SUFFIX)).alias("alias"), "store_name")


# Product-code rule of the binding. Book products carry code = part key and a barcode
# BOOK_BARCODE_PREFIX + the key padded to BARCODE_DIGITS. A platform lists a product
# under the book code, except: PROMO_TYPE parts are listed under the platform's own code
# (prefix per platform) with the book barcode, so they match through the barcode (J6);
# parts of the platform's ORPHAN_SIZE are listed under the platform's own code without
# a usable barcode (mt gives an in-store barcode the book side does not know), so they
# stay unmatched.
BOOK_BARCODE_PREFIX, STORE_BARCODE_PREFIX, BARCODE_DIGITS = "69", "20", 11
PROMO_TYPE = "PROMO"
OWN_CODE_PREFIX = {PLATFORM_JD: "JD", PLATFORM_MT: "MT"}
ORPHAN_SIZE = {PLATFORM_JD: 50, PLATFORM_MT: 49}


def _barcode(prefix: str, key: str = "product_key"):
    return F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), BARCODE_DIGITS, "0"))


def product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: the code and barcode each platform lists it under, and its name."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_key"), F.col("p_name").alias("product_name"),
        "p_type", "p_size")
    cols = [F.col("product_key"), F.col("product_name")]
    key = F.col("product_key").cast("string")
    promo = F.col("p_type") == PROMO_TYPE
    for plat, tag in ((PLATFORM_JD, "jd"), (PLATFORM_MT, "mt")):
        orphan = F.col("p_size") == ORPHAN_SIZE[plat]
        own = F.concat(F.lit(OWN_CODE_PREFIX[plat]), key)
        cols.append(F.when(promo | orphan, own).otherwise(key).alias(f"{tag}_code"))
        bc = F.when(promo, _barcode(BOOK_BARCODE_PREFIX))
        if plat == PLATFORM_MT:
            bc = bc.when(orphan, _barcode(STORE_BARCODE_PREFIX))
        cols.append(bc.alias(f"{tag}_barcode"))
    return p.select(*cols)


BOOK, JD, MT = "book", "jd", "mt"


def side_rows(keyed_detail: DataFrame, only: str | None = None) -> DataFrame:
    """The detail as one row per (store, product, side) that holds a quantity.

    Book and platform consumers of one query both start here. What lies below the
    ``inline`` needs all three quantities for every consumer, so its plans are equal and
    Spark runs the scan and the reconciliation shuffle once and reuses them. Keys and codes
    come out of the generated rows for the same reason: a consumer's filter on them (a join
    asks for keys that are not null) stays above. ``only`` one side of a detail that is held
    needs neither: its rows alone are made.
    """
    keys = [F.col("store_key"), F.col("product_key")]
    codes = [F.col("store_key").cast("string").alias("store_code"), product_code(),
             _barcode(BOOK_BARCODE_PREFIX).alias("book_barcode")]
    quantities = {BOOK: "bojun_qty", JD: "jd_qty", MT: "mt_qty"}
    if only is not None:
        return keyed_detail.where(F.col(quantities[only]).isNotNull()).select(
            *keys, F.lit(only).alias("side"), F.col(quantities[only]).alias("qty"), *codes)
    sides = F.array(*[F.struct(*keys, F.lit(s).alias("side"), F.col(c).alias("qty"), *codes) for s, c in quantities.items()])
    return keyed_detail.select(F.inline(sides)).where(F.col("qty").isNotNull())


def book_products(keyed_detail: DataFrame) -> DataFrame:
    """(product_code, barcode) of the book side: products with book stock."""
    return side_rows(keyed_detail).where(F.col("side") == BOOK).select(
        "product_code", F.col("book_barcode").alias("barcode"))


def book_rows(keyed_detail: DataFrame, stores_df: DataFrame, barcodes: bool = False, held: bool = False) -> DataFrame:
    """(warehouse, product_code, qty) of the book side, under the book's warehouse names; with
    ``barcodes`` also store_code and barcode, as an API pull has them; ``held``: the detail is persisted."""
    more = ["store_code", F.col("book_barcode").alias("barcode")] if barcodes else []
    rows = side_rows(keyed_detail, BOOK if held else None).where(F.col("side") == BOOK)
    return (rows.join(stores_df, "store_key")
            .select(_warehouse_name().alias("warehouse"), "product_code", "qty", *more))


def platform_rows(keyed_detail: DataFrame, codes: DataFrame, only: str | None = None) -> DataFrame:
    """Platform stock rows in the J6 input shape, under the codes each platform uses.

    ``codes``: ``product_codes``; joined on the product key (one row per product, so
    no row is multiplied). Both platforms come out of one pass (``inline``), or ``only`` one side.
    """
    jd = F.col("side") == JD
    rows = side_rows(keyed_detail, only).where(F.col("side") != BOOK).join(codes.drop("product_name"), "product_key", "left")
    return rows.select(
        _platform(), F.when(jd, F.col("jd_code")).otherwise(F.col("mt_code")).alias("platform_code"),
        _outlet_code().alias("store"), F.when(jd, F.col("jd_barcode")).otherwise(F.col("mt_barcode")).alias("barcode"),
        "qty")


def _platform():
    return F.when(F.col("side") == JD, F.lit(PLATFORM_JD)).otherwise(F.lit(PLATFORM_MT)).alias("platform")


def _outlet_code():
    code = F.col("store_code")
    return F.when(F.col("side") == JD, code).otherwise(F.concat(F.lit("mt"), code))


def platform_names(codes: DataFrame) -> DataFrame:
    """(platform_code, product_name) for every code a platform uses (J7 name lookup)."""
    return (codes.select(F.col("jd_code").alias("platform_code"), "product_name")
            .unionByName(codes.select(F.col("mt_code").alias("platform_code"), "product_name")))


def product_code():
    """The product code of the binding: the part key as text."""
    return F.col("product_key").cast("string").alias("product_code")


def outlet_stock_rows(keyed_detail: DataFrame) -> DataFrame:
    """(platform, outlet_code, product_code, qty) for both platforms in one pass."""
    return side_rows(keyed_detail).where(F.col("side") != BOOK).select(
        _platform(), _outlet_code().alias("outlet_code"), "product_code", "qty")


# Geocoder level names used by the bound geocode cache (values a geocoder returns).
LEVEL_HOUSE, LEVEL_POI, LEVEL_DISTRICT = "门牌号", "兴趣点", "区县"


def geo_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geocode cache (store_geo shape) as derived from the store addresses.

    Status, level and coordinates are functions of the supplier balance, so the cache
    holds ok and fail rows, precise and coarse levels.
    """
    st = stores(spark, sf_dir)
    bal = F.col("balance")
    ok = bal >= 500
    return st.select(
        F.btrim("store_address").alias("address"),
        F.when(ok, F.lit(73.0) + (bal + 1000.0) / 12000.0 * 62.0).alias("lng"),
        F.when(ok, F.lit(18.0) + (bal + 1000.0) / 12000.0 * 35.0).alias("lat"),
        F.when(ok, (F.col("store_key") + 110000).cast("string")).alias("adcode"),
        F.when(ok, F.col("store_address")).alias("formatted_address"),
        F.when(ok, F.when(bal >= 5000, F.lit(LEVEL_HOUSE)).when(bal >= 0, F.lit(LEVEL_POI))
               .otherwise(F.lit(LEVEL_DISTRICT))).alias("level"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("fail")).alias("status"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )


def geo_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later geocode batch over the same addresses: ok for a balance in [0, 9000)
    (so some fail rows turn ok, and ok rows above 9000 now fail and must keep their
    coordinates)."""
    st = stores(spark, sf_dir)
    bal = F.col("balance")
    ok = (bal >= 0) & (bal < 9000)
    return st.select(
        F.btrim("store_address").alias("address"),
        F.when(ok, F.lit(73.5) + (bal + 1000.0) / 12000.0 * 62.0).alias("lng"),
        F.when(ok, F.lit(18.5) + (bal + 1000.0) / 12000.0 * 35.0).alias("lat"),
        F.when(ok, (F.col("store_key") + 120000).cast("string")).alias("adcode"),
        F.when(ok, F.col("store_address")).alias("formatted_address"),
        F.when(ok, F.lit(LEVEL_POI)).alias("level"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("fail")).alias("status"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("updated_at"),
    )


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login events from ``events``: one login per event, profile fields derived from it."""
    return logins_from_events(table(spark, sf_dir, "events"))


def logins_from_events(events: DataFrame) -> DataFrame:
    """The login columns of one event (batch or streaming frame)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value")
    uid = F.col("user_id").cast("string")
    et = F.col("event_type")
    return ev.select(
        "event_id", "ts",
        F.concat(F.lit("ou_"), uid).alias("open_id"),
        F.when(et != "error", F.concat(F.lit("on_"), uid)).alias("union_id"),
        F.when(et != "click", uid).alias("feishu_user_id"),
        F.concat(F.upper(et), F.lit(" "), uid).alias("name"),
        F.concat(F.lit("avatar/"), et, F.lit("/"), uid).alias("avatar_url"),
        F.when(et == "purchase", F.concat(F.lit("u"), uid, F.lit("@mail.test"))).alias("email"),
        F.when(et == "signup", F.concat(F.lit("u"), uid, F.lit("@corp.test"))).alias("enterprise_email"),
        F.when(F.col("value") >= 40, F.floor(F.col("value") * 100).cast("bigint").cast("string")).alias("mobile"),
    )
