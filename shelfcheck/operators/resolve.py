"""Resolve, then reconcile: what the systems call stores and products is reduced to its distinct
names and codes, these are resolved once (J4, J6) into mapping tables, and the rows of every
side meet the mappings, not the lookups, before J1. What resolves to nothing goes to the
unmatched lists only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.contracts import PLATFORM_JD, PLATFORM_MT
from shelfcheck.functions.scalars import strip_all
from shelfcheck.operators import match as mt
from shelfcheck.operators.reconcile import reconcile, stack_sides

SIDE_OF = {PLATFORM_JD: "jd", PLATFORM_MT: "mt"}


# ---------------------------------------------------------------- mappings

def warehouse_mapping(book: DataFrame, stores: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """J4 as a mapping: one row per distinct book warehouse that resolves, with its store_key."""
    names = (book.where(F.col("warehouse").isNotNull()).groupBy("warehouse").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
             .withColumn("name", strip_all("warehouse")))
    keys = stores.groupBy(F.col("store_name").alias("resolved_name")).agg(F.min("store_key").alias("store_key"))
    return mt.resolve_names(names, stores, aliases).join(keys, "resolved_name").select("warehouse", "store_key")


def platform_store_mapping(stores: DataFrame) -> DataFrame:
    """(platform, store, store_key): which store carries a platform's store id."""
    ids = stores.select(
        "store_key", F.inline(F.array(
            F.struct(F.lit(PLATFORM_JD).alias("platform"), F.col("jd_id").alias("store")),
            F.struct(F.lit(PLATFORM_MT).alias("platform"), F.col("meituan_id").alias("store")))))
    return ids.where(F.col("store").isNotNull()).groupBy("platform", "store").agg(F.min("store_key").alias("store_key"))


def mapping_tables(book: DataFrame, platform: DataFrame, stores: DataFrame, aliases: DataFrame | None,
                   book_products: DataFrame) -> dict[str, DataFrame]:
    """The three mappings by table name, to be written (``write_mappings``) and joined."""
    return {"warehouse_mapping": warehouse_mapping(book, stores, aliases),
            "platform_store_mapping": platform_store_mapping(stores),
            "product_mapping": mt.product_mapping(platform, book_products)}


def write_mappings(spark: SparkSession, root: str, mappings: dict[str, DataFrame], version: str) -> dict[str, DataFrame]:
    """Publish the mappings as one version below ``root`` and read them back: later runs join the
    tables, and plans that join them hold scans in place of the matching."""
    from shelfcheck.sources.ingest import publish

    made = publish(spark, root, mappings, version)
    return {name: spark.read.schema(mappings[name].schema).parquet(path) for name, path in made.tables.items()}


# ---------------------------------------------------------------- rows

def resolve_book(book: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Book rows (warehouse, product_code, qty) with the ``store_key`` of their warehouse, null
    where it resolves to none. Rows without a warehouse spread by product."""
    key = F.coalesce("warehouse", F.concat(F.lit("\u0001"), F.coalesce("product_code", F.lit(""))))
    known = warehouses.select(F.col("warehouse").alias("_warehouse"), "store_key")
    keyed = book.withColumn("_key", key)
    return keyed.join(known, keyed["_key"] == known["_warehouse"], "left").select("store_key", "product_code", "qty")


def resolve_platform(rows: DataFrame, store_ids: DataFrame, products: DataFrame) -> DataFrame:
    """Platform rows (platform, platform_code, store, barcode, qty) with the ``store_key`` that
    carries the platform's store id and the book's ``product_code`` (J6); null where none."""
    keyed = rows.select("platform", "store", "qty", mt.code_key().alias("code_key"))
    coded = keyed.join(products, ["platform", "code_key"], "left")
    place = coded.withColumn("_store", F.coalesce("store", F.concat(F.lit("\u0001"), F.col("code_key"))))
    ids = store_ids.withColumnRenamed("store", "_store")
    return place.join(ids, ["platform", "_store"], "left").select("platform", "store_key", "product_code", "qty")


def resolved() -> "F.Column":
    return F.col("store_key").isNotNull() & F.col("product_code").isNotNull()


def reconcile_resolved(book: DataFrame, platform: DataFrame, virtual_threshold: int) -> DataFrame:
    """J1 over what resolved: one row per (store_key, product_code) with quantities, diffs
    and flag. Inputs are ``resolve_book`` / ``resolve_platform`` results. Book rows carry the
    book's own code, so only their store has to resolve; rows without a code share a key."""
    keys = ("store_key", "product_code")
    sides = {"book": book.where(F.col("store_key").isNotNull())}
    for name, side in SIDE_OF.items():
        sides[side] = platform.where(resolved() & (F.col("platform") == name))
    lines = stack_sides(sides, keys=keys).drop("book_name", "jd_name", "mt_name")
    return reconcile(lines, virtual_threshold, keys)


def balance(platform: DataFrame) -> DataFrame:
    """Per platform: total quantity = reconciled + unmatched quantity."""
    return platform.groupBy("platform").agg(
        F.sum("qty").alias("total_qty"),
        F.coalesce(F.sum(F.when(resolved(), F.col("qty"))), F.lit(0)).alias("reconciled_qty"),
        F.coalesce(F.sum(F.when(~resolved(), F.col("qty"))), F.lit(0)).alias("unmatched_qty"))
