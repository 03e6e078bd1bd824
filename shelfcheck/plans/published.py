"""K1 / K2 from published tables: the current versions of the book, both platforms, the store
mapping, the outlets and, if there is one, the alias table become report inputs, and the
reports are written under a key of what they were built from. An unchanged load is not rebuilt.

Stores are keyed by the mapping's store name and products by the book's code. Rows of every
side are resolved by mapping tables first (operators/resolve.py), which are published as well.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.contracts import PLATFORM_JD, PLATFORM_MT
from shelfcheck.operators import guard as gd
from shelfcheck.operators import resolve as rs
from shelfcheck.operators import rollup as ru
from shelfcheck.operators.common import is_active_store
from shelfcheck.plans.reports import ReconInputs, write_reports
from shelfcheck.sources.files import Files
from shelfcheck.sources.ingest import current_path

BOOK, JD, MT = "bojun_offline_inventory", "jd_store_inventory", "meituan_store_inventory"
MAPPING, JD_OUTLETS, MT_OUTLETS, ALIASES = "feishu_store_mapping", "feishu_jd_outlet", "feishu_meituan_outlet", "store_alias"
NEEDED = (BOOK, JD, MT, MAPPING, JD_OUTLETS, MT_OUTLETS)


def current_paths(spark: SparkSession, root: str) -> dict[str, str]:
    """The current version of every table the reports read; the alias table may be missing."""
    paths = {t: current_path(spark, root, t) for t in (*NEEDED, ALIASES)}
    missing = [t for t in NEEDED if paths[t] is None]
    if missing:
        raise FileNotFoundError(f"not published: {missing}")
    return {t: p for t, p in paths.items() if p}


def _text(df: DataFrame, name: str, alias: str | None = None):
    """A column as text, null where the table has none."""
    return (F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")).alias(alias or name)


def _whole(name: str):
    return F.col(name).cast("double").cast("bigint").alias("qty")


def store_dimension(mapping: DataFrame) -> DataFrame:
    """One row per store name of the mapping; ids are the largest of its active rows (J2), the
    store is active if one of them is."""
    active = is_active_store("remark")
    texts = ("customer_name", "province", "city", "internal_code", "store_address")
    rows = mapping.where(F.col("store_name").isNotNull()).select(
        "store_name", *[_text(mapping, c) for c in (*texts, "remark", "jd_id", "meituan_id")])
    return rows.groupBy("store_name").agg(
        *[F.max(c).alias(c) for c in texts],
        *[F.coalesce(F.max(F.when(active, F.col(c))), F.max(c)).alias(c) for c in ("jd_id", "meituan_id")],
        F.when(~F.max(active), F.max("remark")).alias("remark")).withColumn("store_key", F.col("store_name"))


def report_inputs(spark: SparkSession, root: str, virtual_threshold: int, scratch: str,
                  jd_stock: str = "available_stock") -> ReconInputs:
    """The reports' inputs from the tables published below ``root``. The mapping tables are
    published below ``scratch``. ``jd_stock`` names the jd column that is reconciled."""
    t = {name: spark.read.parquet(path) for name, path in current_paths(spark, root).items()}
    stores = store_dimension(t[MAPPING])
    book = t[BOOK].select(F.col("store_warehouse").alias("warehouse"), _text(t[BOOK], "store_code"), _text(t[BOOK], "product_code"),
                          _text(t[BOOK], "barcode"), _text(t[BOOK], "product_name"), _whole("stock_qty"))
    jd = t[JD].select(F.lit(PLATFORM_JD).alias("platform"), F.coalesce(_text(t[JD], "merchant_product_code"), _text(t[JD], "sku_code"))
                      .alias("platform_code"), _text(t[JD], "store_code", "store"), _text(t[JD], "barcode"),
                      _text(t[JD], "product_name"), _whole(jd_stock))
    mt = t[MT].select(F.lit(PLATFORM_MT).alias("platform"), F.coalesce(_text(t[MT], "internal_sku_code"), _text(t[MT], "sku_id"))
                      .alias("platform_code"), _text(t[MT], "store_id", "store"), _text(t[MT], "barcode"),
                      _text(t[MT], "product_name"), _whole("stock_qty"))
    platform = jd.unionByName(mt)
    book_products = book.where(F.col("product_code").isNotNull()).select("product_code", "barcode")
    made = rs.mapping_tables(book, platform, stores, t.get(ALIASES), book_products)
    maps = rs.write_mappings(spark, scratch, made, "1")
    sides = rs.resolve_book(book, maps["warehouse_mapping"]), rs.resolve_platform(
        platform, maps["platform_store_mapping"], maps["product_mapping"])
    detail = rs.reconcile_resolved(*sides, virtual_threshold).withColumnRenamed("product_code", "product_key")
    # The book's name of a product, else a platform's.
    keyed = platform.select("platform", "product_name", rs.mt.code_key().alias("code_key")).join(
        maps["product_mapping"], ["platform", "code_key"])
    named = book.select("product_code", "product_name", F.lit(0).alias("turn")).unionByName(
        keyed.select("product_code", "product_name", F.when(F.col("platform") == PLATFORM_JD, 1).otherwise(2).alias("turn")))
    products = (named.where(F.col("product_code").isNotNull() & F.col("product_name").isNotNull())
                .groupBy("product_code", "turn").agg(F.max("product_name").alias("product_name"))
                .groupBy(F.col("product_code").alias("product_key")).agg(F.min_by("product_name", "turn").alias("product_name")))
    coded = platform.select("platform", F.col("store").alias("outlet_code"), "qty", rs.mt.code_key().alias("code_key")).join(
        maps["product_mapping"].where(F.col("product_code").isNotNull()), ["platform", "code_key"])
    outlets = gd.live_outlets(t[JD_OUTLETS], t[MT_OUTLETS])
    outlets = outlets.withColumn("outlet_code", F.col("outlet_code").cast("string"))
    return ReconInputs(
        keyed_detail=detail, stores=stores, products=products,
        book_warehouses=book.select("warehouse", "store_code").where(F.col("warehouse").isNotNull()).distinct(),
        platform_rows=platform, book_products=book_products, outlets=outlets,
        outlet_stock=gd.outlet_stock(stacked=coded), store_partials=ru.store_partials(detail), aliases=t.get(ALIASES),
        platform_names=platform.groupBy("platform_code").agg(F.max("product_name").alias("product_name")))


def report_key(spark: SparkSession, root: str, virtual_threshold: int, fmt: str) -> str:
    """A key of the versions the reports read and of how they are built."""
    return hashlib.sha256(json.dumps([current_paths(spark, root), virtual_threshold, fmt], sort_keys=True).encode()).hexdigest()[:16]


def build_reports(spark: SparkSession, root: str, out_dir: str, virtual_threshold: int, kinds: tuple[str, ...] = ("recon", "guard"),
                  fmt: str = "parquet", jd_stock: str = "available_stock") -> dict[str, dict[str, str]]:
    """Write the reports over what is published below ``root`` and return their sheets' folders.
    Reports of an unchanged load are there already: their index file names the sheets."""
    files = Files(spark)
    home = f"{out_dir}/{report_key(spark, root, virtual_threshold, fmt)}-{jd_stock}"
    found = {k: files.get(f"{home}/{k}.json") for k in kinds}
    todo = tuple(k for k in kinds if found[k] is None)
    if todo:
        inputs = report_inputs(spark, root, virtual_threshold, f"{home}/_mappings", jd_stock)
        for kind, sheets in write_reports(todo, inputs, home, fmt).items():
            files.put(f"{home}/{kind}.json", sheets)
            found[kind] = sheets
    return found
