"""Line up stores and products across systems; list what does not match.

All matching is equi-join based. Right sides are reduced to one row per key first
(``groupBy`` with a partial aggregate, never a window over a possibly hot key), so a
join can never multiply rows, and a name that holds a third of all rows is combined
map-side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.functions.scalars import strip_all
from shelfcheck.operators.common import distinct_values, is_active_store


# ---------------------------------------------------------------- J3 / A11 addresses

def address_book(addresses: DataFrame, name: str = "name", address: str = "address",
                 order: str = "line_no") -> DataFrame:
    """Store name -> first non-blank address in source order (J3 right side).

    ``order`` is the row's position in its source (numbered by the reader). Both sides
    are stripped of Unicode whitespace; blank names or addresses are skipped.
    """
    a = addresses.select(
        strip_all(name).alias("_name"), strip_all(address).alias("_addr"), F.col(order).alias("_ord"))
    return (
        a.where((F.col("_name") != "") & (F.col("_addr") != ""))
        .groupBy("_name")
        .agg(F.min_by("_addr", "_ord").alias("store_address"))
        .withColumnRenamed("_name", "address_name")
    )


def lookup_address(stores: DataFrame, book: DataFrame, name_col: str = "store_name") -> DataFrame:
    """Add ``store_address`` by stripped store name; unmatched stays null."""
    base = stores.drop("store_address") if "store_address" in stores.columns else stores
    keyed = base.withColumn("_key", strip_all(name_col))
    return keyed.join(book, keyed["_key"] == book["address_name"], "left").drop("_key", "address_name")


def address_match_report(stores: DataFrame, book: DataFrame | None,
                         name_col: str = "store_name") -> tuple[DataFrame | None, DataFrame | None]:
    """(hit count, missing names sorted). Both None when there is no address table."""
    if book is None:
        return None, None
    names = stores.select(strip_all(name_col).alias("name")).where(
        F.col("name").isNotNull() & (F.col("name") != ""))
    joined = names.join(book, names["name"] == book["address_name"], "left")
    hits = joined.agg(F.count("store_address").alias("hit_rows"))
    missing = (names.join(book, names["name"] == book["address_name"], "left_anti")
               .distinct().orderBy("name"))
    return hits, missing


# ---------------------------------------------------------------- J4 / J5 stores

def resolve_names(names: DataFrame, stores: DataFrame, aliases: DataFrame | None,
                  name_col: str = "name") -> DataFrame:
    """A name resolves to itself when it is a known store name, else through the
    alias table (alias -> store_name); otherwise null. Adds ``resolved_name``.

    Both lookup sides are unique per key, so no row is multiplied.
    """
    known = stores.select(F.col("store_name").alias("_direct")).distinct()
    out = names.join(known, names[name_col] == known["_direct"], "left")
    if aliases is not None:
        amap = aliases.groupBy("alias").agg(F.max("store_name").alias("_via_alias"))
        out = out.join(amap, out[name_col] == amap["alias"], "left").drop("alias")
    else:
        out = out.withColumn("_via_alias", F.lit(None).cast("string"))
    return out.withColumn("resolved_name", F.coalesce("_direct", "_via_alias")).drop(
        "_direct", "_via_alias")


def unmatched_stores(stores: DataFrame, book_warehouses: DataFrame,
                     aliases: DataFrame | None = None) -> DataFrame:
    """Active mapped stores that no book warehouse name resolves to.

    ``book_warehouses``: (warehouse, store_code) of the book system. ``bojun_warehouse``
    shows the book warehouse that carries the store's internal code, when there is one
    (the name to fix); S6 order.
    """
    wh = book_warehouses.select(strip_all("warehouse").alias("name"), "store_code").where(
        F.col("name") != "")
    resolved = resolve_names(wh.select("name"), stores, aliases).where(
        F.col("resolved_name").isNotNull()).select(F.col("resolved_name").alias("_hit")).distinct()
    active = stores.where(is_active_store("remark")).where(F.col("store_name").isNotNull())
    missing = active.join(resolved, active["store_name"] == F.col("_hit"), "left_anti")
    by_code = wh.where(F.col("store_code").isNotNull()).groupBy("store_code").agg(
        F.max("name").alias("bojun_warehouse"))
    out = missing.join(by_code, missing["internal_code"] == by_code["store_code"], "left")
    return out.select("store_name", "bojun_warehouse", "province", "city", "jd_id", "meituan_id").orderBy(
        *unmatched_store_order())


def unmatched_store_order() -> list:
    """S6, stores."""
    return [F.col("province").asc_nulls_last(), F.col("city").asc_nulls_last(), F.col("store_name").asc_nulls_last()]


def unmatched_product_order() -> list:
    """S6, products."""
    return [F.col("platform").asc_nulls_last(), F.col("store_cnt").desc(), F.col("platform_code").asc_nulls_last()]


# ---------------------------------------------------------------- J6 / J7 products

def barcode_map(book_products: DataFrame) -> DataFrame:
    """Book barcode -> product_code, made unique (max code) so the fallback join
    cannot multiply platform rows."""
    return (book_products.where(F.col("barcode").isNotNull())
            .groupBy("barcode").agg(F.max("product_code").alias("_by_barcode")))


def _barcode_key(code_col: str):
    """Join key of the barcode lookup. A row that needs none (matched by code, or without a
    barcode) gets a key of its own that no barcode equals, so such rows spread evenly instead
    of meeting in the null partition."""
    own = F.concat(F.lit("\u0000"), F.coalesce(code_col, F.lit("")), F.lit("\u0000"), F.coalesce("store", F.lit("")))
    return F.when(F.col("_by_code").isNull() & F.col("barcode").isNotNull(), F.col("barcode")).otherwise(own)


def match_products(platform_rows: DataFrame, book_products: DataFrame,
                   code_col: str, use_barcode: bool) -> DataFrame:
    """Platform row -> book product_code by platform code, else by barcode.

    ``book_products``: (product_code, barcode), one row per book stock line, reduced to
    distinct (code, barcode) pairs first. Only rows whose code misses and that carry a
    barcode take part in the barcode lookup. Adds ``matched_code`` (null = no match).
    """
    pairs = distinct_values(book_products, "product_code", "barcode")
    codes = pairs.select(F.col("product_code").alias("_by_code")).distinct()
    out = platform_rows.join(codes, platform_rows[code_col] == codes["_by_code"], "left")
    if use_barcode:
        if "store" not in out.columns:
            out = out.withColumn("store", F.lit(None).cast("string"))
        known = barcode_map(pairs).withColumnRenamed("barcode", "_barcode")
        out = out.withColumn("_key", _barcode_key(code_col))
        out = out.join(known, out["_key"] == known["_barcode"], "left").drop("_key", "_barcode")
        if "store" not in platform_rows.columns:
            out = out.drop("store")
    else:
        out = out.withColumn("_by_barcode", F.lit(None).cast("string"))
    return out.withColumn("matched_code", F.coalesce("_by_code", "_by_barcode")).drop(
        "_by_code", "_by_barcode")


def code_key(code: str = "platform_code", barcode: str = "barcode", spread: str = "store"):
    """One text for the (code, barcode) a platform row is matched by. Rows with neither can match
    nothing: they get texts of their own, by ``spread``, so that they do not meet in one task."""
    none = F.lit("\u0001")
    both = F.concat(F.coalesce(code, none), F.lit("\u0000"), F.coalesce(barcode, none))
    own = F.concat(F.lit("\u0002"), F.coalesce(spread, F.lit(""))) if spread else F.lit(None).cast("string")
    return F.when(F.coalesce(code, barcode).isNotNull(), both).otherwise(own)


def product_mapping(platform_rows: DataFrame, book_products: DataFrame) -> DataFrame:
    """J6 as a mapping: one row per distinct (platform, code, barcode) with the book code it
    matches (null = none) and its ``code_key``. The matching joins run over these, not over rows."""
    codes = (platform_rows.where(F.coalesce("platform_code", "barcode").isNotNull())
             .groupBy("platform", "platform_code", "barcode").agg(F.count(F.lit(1)).alias("_n")).drop("_n"))
    matched = match_products(codes, book_products, "platform_code", use_barcode=True)
    return matched.select("platform", code_key(spread=None).alias("code_key"), F.col("matched_code").alias("product_code"))


def unmatched_rows(platform_rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """The rows whose code and barcode match nothing: one anti join with the mapping."""
    known = mapping.where(F.col("product_code").isNotNull()).select("platform", "code_key")
    keyed = platform_rows.withColumn("code_key", code_key())
    return keyed.join(known, ["platform", "code_key"], "left_anti").withColumn("matched_code", F.lit(None).cast("string"))


def unmatched_products(matched: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per (platform, platform_code) without a match: name, barcode, stores, qty.

    Input: (platform, platform_code, store, [product_name,] barcode, qty, matched_code).
    Stores are counted after a first reduction to (platform, code, store), so no
    DISTINCT aggregate and no hot key crosses the shuffle unreduced. ``names``
    (platform_code, product_name) fills in names after the reduction, so only
    unmatched codes are looked up. S6 order.
    """
    miss = matched.where(F.col("matched_code").isNull())
    if "product_name" not in miss.columns:
        miss = miss.withColumn("product_name", F.lit(None).cast("string"))
    per_store = miss.groupBy("platform", "platform_code", "store").agg(
        F.max("product_name").alias("product_name"), F.max("barcode").alias("barcode"),
        F.sum("qty").alias("qty"))
    out = per_store.groupBy("platform", "platform_code").agg(
        F.max("product_name").alias("product_name"), F.max("barcode").alias("barcode"),
        F.count("store").alias("store_cnt"), F.sum("qty").alias("total_qty"))
    if names is not None:
        nm = names.groupBy("platform_code").agg(F.max("product_name").alias("_name"))
        out = out.join(nm, "platform_code", "left").withColumn(
            "product_name", F.coalesce("product_name", "_name")).drop("_name")
    return out.select("platform", "platform_code", "product_name", "barcode", "store_cnt",
                      "total_qty").orderBy(*unmatched_product_order())
