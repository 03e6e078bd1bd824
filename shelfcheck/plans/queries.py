"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They run the library operators over the bound test tables (sources/testbind.py).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.contracts import PLATFORM_JD, PLATFORM_MT
from shelfcheck.operators import reconcile as rc
from shelfcheck.operators import rollup as ru
from shelfcheck.session import scratch_path
from shelfcheck.sources import testbind as tb

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a query's own tables, below the shared checkpoint folder."""
    return scratch_path(spark, "queries", f"{name}-{uuid.uuid4().hex}")


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = lambda spark, d: fn(spark, tb.TableFolder(d))
        return fn
    return deco


# ---------------------------------------------------------------- building blocks

def keyed_detail(spark: SparkSession, d: str) -> DataFrame:
    """J1 keyed by (store_key, product_key)."""
    return rc.reconcile(tb.stock_lines(spark, d), tb.VIRTUAL_THRESHOLD)


def named_detail(spark: SparkSession, d: str) -> DataFrame:
    """J1 with customer / store / product names (v_recon_detail shape + keys)."""
    return rc.attach_dims(keyed_detail(spark, d), tb.stores(spark, d), tb.products(spark, d))


# ---------------------------------------------------------------- reconciliation

@register("customer_summary")
def customer_summary(spark: SparkSession, d: str) -> DataFrame:
    """A1 + A3 + A4 + S2: the customer sheet of the recon report."""
    st = tb.stores(spark, d)
    return ru.customer_summary(ru.store_level(keyed_detail(spark, d), st))


@register("store_summary")
def store_summary(spark: SparkSession, d: str) -> DataFrame:
    """A2 + J2 + S3: the store sheet of the recon report."""
    st = tb.stores(spark, d)
    return ru.store_summary(ru.store_level(keyed_detail(spark, d), st), st)


@register("recon_detail")
def recon_detail(spark: SparkSession, d: str) -> DataFrame:
    """J1 + J12 + S1: every (customer, store, product) with quantities, diffs and flag."""
    return named_detail(spark, d).select(*rc.DETAIL_COLUMNS).orderBy(
        F.col("customer_name").asc_nulls_last(), F.col("store_name").asc_nulls_last(),
        F.col("product_code").asc_nulls_last())


@register("detail_report")
def detail_report(spark: SparkSession, d: str) -> DataFrame:
    """K1 detail sheet: detail + J2 ids + A5 per-row rates."""
    return ru.detail_report(named_detail(spark, d), tb.stores(spark, d))


@register("flag_counts")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    """rows per flag with the flag's index."""
    return (
        keyed_detail(spark, d).groupBy("flag").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("flag_idx", rc.flag_index("flag"))
        .orderBy("flag_idx")
    )


@register("inactive_count")
def inactive_count(spark: SparkSession, d: str) -> DataFrame:
    """Store dimension rows that are not active."""
    return ru.inactive_count(tb.stores(spark, d))


# ---------------------------------------------------------------- outlet guard

def guard_inputs(spark: SparkSession, d: str, detail: DataFrame | None = None):
    """(live outlets, outlet stock, dealer products, product names) from the bound tables.

    Outlet stock (keyed by the platform's outlet code: jd code = supplier key, mt id =
    'mt' + supplier key) and dealer totals come from one pass over the detail's sides.
    """
    from shelfcheck.operators import guard as gd

    det = detail if detail is not None else keyed_detail(spark, d)
    outlets = gd.live_outlets(tb.jd_outlets(spark, d), tb.mt_outlets(spark, d))
    stock = gd.outlet_stock(stacked=tb.outlet_stock_rows(det), assume_unique=True)
    st = tb.stores(spark, d)
    book = (tb.side_rows(det).where(F.col("side") == tb.BOOK).join(st.select("store_key", "customer_name"), "store_key")
            .select("customer_name", "product_code", F.col("qty").alias("bojun_qty")))
    names = tb.products(spark, d).select(tb.product_code(), "product_name")
    return outlets, stock, gd.dealer_products(book), names


@register("outlet_summary")
def outlet_summary(spark: SparkSession, d: str) -> DataFrame:
    """A6 + S4: per live outlet, products of its dealer and how many are covered."""
    from shelfcheck.operators import guard as gd

    outlets, stock, products, _ = guard_inputs(spark, d)
    return gd.outlet_summary(outlets, stock, products)


@register("guard_listed_detail")
def guard_listed_detail(spark: SparkSession, d: str) -> DataFrame:
    """K2 detail for listed products, with F7 status and S5 order."""
    from shelfcheck.operators import guard as gd

    return gd.listed_detail(*guard_inputs(spark, d))


@register("outlet_detail")
def outlet_detail(spark: SparkSession, d: str) -> DataFrame:
    """drill into the worst-covered outlet (first in report order): all dealer products."""
    from shelfcheck.operators import guard as gd

    outlets, stock, products, names = guard_inputs(spark, d)
    worst = gd.worst_outlet(gd.outlet_summary(outlets, stock, products))
    return gd.outlet_detail(worst, stock, products, names)


# ---------------------------------------------------------------- matching

@register("unmatched_stores")
def unmatched_stores(spark: SparkSession, d: str) -> DataFrame:
    """J4 + J5 + S6: active mapped stores no book warehouse resolves to, directly or
    through the alias table."""
    from shelfcheck.operators import match as mt

    st = tb.stores(spark, d)
    parts = ru.store_partials(keyed_detail(spark, d))
    return mt.unmatched_stores(st, tb.book_warehouses(parts, st), tb.store_aliases(spark, d))


@register("unmatched_products")
def unmatched_products(spark: SparkSession, d: str) -> DataFrame:
    """J6 + J7 + S6: platform codes that match no book product by code or by barcode."""
    from shelfcheck.operators import match as mt

    det = keyed_detail(spark, d)
    codes = tb.product_codes(spark, d)
    rows = tb.platform_rows(det, codes)
    mapping = mt.product_mapping(rows, tb.book_products(det))
    return mt.unmatched_products(mt.unmatched_rows(rows, mapping), tb.platform_names(codes))


@register("store_address_hits")
def store_address_hits(spark: SparkSession, d: str) -> DataFrame:
    """J3 + A11: stores that find an address (first non-blank per name in source order)."""
    from shelfcheck.operators import match as mt

    st = tb.stores(spark, d)
    src = st.select(F.col("store_name").alias("name"), F.col("store_address").alias("address"),
                    F.col("store_key").alias("line_no"))
    hits, _ = mt.address_match_report(st, mt.address_book(src))
    return hits


# ---------------------------------------------------------------- report inputs

def recon_inputs(spark: SparkSession, d: str, detail: DataFrame | None = None):
    """All report inputs over the bound tables; ``detail`` may be a persisted J1."""
    from shelfcheck.plans.reports import ReconInputs

    d = tb.TableFolder(d)
    det = detail if detail is not None else keyed_detail(spark, d)
    st = tb.stores(spark, d)
    outlets, stock, _, _ = guard_inputs(spark, d, det)
    parts = ru.store_partials(det)
    codes = tb.product_codes(spark, d)
    return ReconInputs(
        keyed_detail=det,
        stores=st,
        products=tb.products(spark, d),
        book_warehouses=tb.book_warehouses(parts, st),
        platform_rows=tb.platform_rows(det, codes),
        book_products=tb.book_products(det),
        outlets=outlets,
        outlet_stock=stock,
        store_partials=parts,
        aliases=tb.store_aliases(spark, d),
        platform_names=tb.platform_names(codes),
        shared=(codes,),
    )


# ---------------------------------------------------------------- geo and map

@register("address_sources")
def address_sources(spark: SparkSession, d: str) -> DataFrame:
    """A8 + U1: distinct addresses of active stores and live outlets with their city."""
    from shelfcheck.operators import geo

    return geo.address_sources(tb.stores(spark, d), tb.jd_outlets(spark, d), tb.mt_outlets(spark, d))


@register("geocode_queue_retry")
def geocode_queue_retry(spark: SparkSession, d: str) -> DataFrame:
    """J9 + U2: addresses to geocode when failed ones are retried."""
    from shelfcheck.operators import geo

    src = geo.address_sources(tb.stores(spark, d), tb.jd_outlets(spark, d), tb.mt_outlets(spark, d))
    return geo.geocode_queue(src, tb.geo_cache(spark, d), retry_fail=True)


@register("geo_levels")
def geo_levels(spark: SparkSession, d: str) -> DataFrame:
    """A9 + S11: level histogram of ok cache rows, most frequent first."""
    from shelfcheck.operators import geo

    return geo.geo_quality(tb.geo_cache(spark, d))[0]


@register("geo_coarse")
def geo_coarse(spark: SparkSession, d: str) -> DataFrame:
    """Ok cache rows only placed at an administrative centre."""
    from shelfcheck.operators import geo

    return geo.geo_quality(tb.geo_cache(spark, d))[1]


@register("geo_upsert")
def geo_upsert(spark: SparkSession, d: str) -> DataFrame:
    """M1: geocode batches merged into the stored cache on read (fail keeps coordinates): one in
    which every address fails, compacted, and a later one of which the result is shown."""
    from shelfcheck.operators.changes import geo_table

    cache, results = geo_table(spark, scratch(spark, "geo")), tb.geo_results(spark, d)
    cache.replace(tb.geo_cache(spark, d))
    cache.append(results.withColumn("status", F.lit("fail")).withColumn("updated_at", F.col("updated_at") - F.expr("INTERVAL 1 DAY")))
    cache.compact()
    cache.append(results)
    return cache.read()


def _map_points(spark: SparkSession, d: str) -> DataFrame:
    from shelfcheck.operators import geo

    return geo.map_points(tb.stores(spark, d), tb.jd_outlets(spark, d), tb.mt_outlets(spark, d),
                          tb.geo_cache(spark, d),
                          geo.point_sku_counts(unique=tb.outlet_stock_rows(keyed_detail(spark, d))))


@register("map_points")
def map_points(spark: SparkSession, d: str) -> DataFrame:
    """J10 + J11 + F6 + S10: map points with coordinates and SKU counts."""
    from shelfcheck.operators import geo

    return _map_points(spark, d).withColumn("type_idx", geo.point_type_index())


@register("map_located")
def map_located(spark: SparkSession, d: str) -> DataFrame:
    """A10: map points in total and with coordinates."""
    from shelfcheck.operators import geo

    return geo.located_count(geo.located_points(tb.stores(spark, d), tb.jd_outlets(spark, d),
                                                tb.mt_outlets(spark, d), tb.geo_cache(spark, d)))


# ---------------------------------------------------------------- users

@register("login_profiles")
def login_profiles(spark: SparkSession, d: str) -> DataFrame:
    """User profiles from login events."""
    from shelfcheck.operators import logins as lg

    return lg.profile_from_logins(tb.logins(spark, d)).select(*lg.PROFILE_COLS)


@register("user_list")
def user_list(spark: SparkSession, d: str) -> DataFrame:
    """S9 + X5: the 500 most recent users (a top-k report), times to the minute."""
    from shelfcheck.operators import logins as lg

    return lg.user_list(lg.profile_from_logins(tb.logins(spark, d)))


@register("book_pull_stats")
def book_pull_stats(spark: SparkSession, d: str) -> DataFrame:
    """I16: records, distinct warehouses and distinct products of the book stock lines; a line of an
    unknown store is a record."""
    from shelfcheck.sources.pages import inventory_pull_stats

    rows = (tb.stock_lines(spark, d).where(F.col("bojun_qty").isNotNull())
            .join(tb.stores(spark, d).select("store_key", F.col("store_name").alias("store_warehouse")), "store_key", "left"))
    return inventory_pull_stats(rows.select("store_warehouse", tb.product_code()))


@register("login_profiles_stream")
def login_profiles_stream(spark: SparkSession, d: str) -> DataFrame:
    """M5: the same profiles, built by Structured Streaming over the landed events: they
    arrive in three deliveries that interleave in time (the later ones are all late), and a
    fourth delivers a part of them again with another time. Some events lack their time, some
    their id; those without an id are delivered once."""
    from shelfcheck.operators.logins import PROFILE_COLS
    from shelfcheck.streaming.logins import profiles_via_stream

    landing = scratch(spark, "landing")
    events, number = tb.table(spark, d, "events"), F.col("event_id")
    events = events.withColumn("ts", F.when(number % 89 != 7, F.col("ts")))
    part, named = F.pmod(number, F.lit(3)), F.when(number % 97 != 5, number)
    again = events.where((number % 10 == 0) & named.isNotNull()).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    for k, rows in enumerate([*[events.where(part == x).withColumn("event_id", named) for x in (2, 0, 1)], again]):
        rows.write.parquet(f"{landing}/delivery{k}")
    return profiles_via_stream(spark, f"{landing}/*", tb.logins_from_events, files_per_batch=16).select(*PROFILE_COLS)


# ---------------------------------------------------------------- report sections, ingest, export

@register("outlet_ranking")
def outlet_ranking(spark: SparkSession, d: str) -> DataFrame:
    """S4 dashboard form: outlets worst first by the unrounded ok share."""
    from shelfcheck.operators import guard as gd

    outlets, stock, products, _ = guard_inputs(spark, d)
    return gd.outlet_ranking(gd.outlet_summary(outlets, stock, products))


@register("payload_detail")
def payload_detail(spark: SparkSession, d: str) -> DataFrame:
    """K3 detail section: detail rows with the flag index (F5) instead of its text."""
    return named_detail(spark, d).select(
        *rc.DETAIL_COLUMNS[:-1], rc.flag_index("flag").alias("flag_idx"))


@register("column_types")
def column_types(spark: SparkSession, d: str) -> DataFrame:
    """I8 + I9: types inferred for the supplier and part exports read as text."""
    from shelfcheck.sources.ingest import infer_types

    rows = []
    for name in ("supplier", "part"):
        t = tb.table(spark, d, name)
        as_text = t.select(*[F.col(c).cast("string").alias(c) for c in t.columns])
        rows += [(name, c, typ) for c, typ in infer_types(as_text).items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, inferred_type string")


@register("store_export")
def store_export(spark: SparkSession, d: str) -> DataFrame:
    """K5 + F3 + S7: the store mapping exported with its source headers."""
    from shelfcheck.plans.tables import export_table

    st = tb.stores(spark, d).select(
        F.col("store_key").alias("id"), "province", "city", "customer_name", "store_name",
        "internal_code", "remark", "jd_id", "meituan_id", "store_address")
    return export_table(st, "mapping")


# ---------------------------------------------------------------- resolve, then reconcile

def _resolved_sides(spark: SparkSession, d: str):
    """(book, platform) rows of one pass with their resolved store and product."""
    from shelfcheck.operators import resolve as rs

    det, st = keyed_detail(spark, d), tb.stores(spark, d)
    book, rows = tb.book_rows(det, st), tb.platform_rows(det, tb.product_codes(spark, d))
    made = rs.mapping_tables(book, rows, st, tb.store_aliases(spark, d), tb.book_products(det))
    maps = rs.write_mappings(spark, scratch(spark, "mappings"), made, "1")
    return (rs.resolve_book(book, maps["warehouse_mapping"]),
            rs.resolve_platform(rows, maps["platform_store_mapping"], maps["product_mapping"]))


def _resolved_detail(spark: SparkSession, d: str) -> DataFrame:
    from shelfcheck.operators import resolve as rs

    return rs.reconcile_resolved(*_resolved_sides(spark, d), tb.VIRTUAL_THRESHOLD)


@register("recon_resolved_detail")
def recon_resolved_detail(spark: SparkSession, d: str) -> DataFrame:
    """J4 + J6 -> J1: the reconciliation of matched stores and products."""
    names = tb.stores(spark, d).select("store_key", "customer_name", "store_name")
    return _resolved_detail(spark, d).join(names, "store_key").select(
        "customer_name", "store_name", "product_code", "bojun_qty", "jd_qty", "mt_qty", "jd_diff", "mt_diff", "flag")


@register("recon_resolved_customer")
def recon_resolved_customer(spark: SparkSession, d: str) -> DataFrame:
    """The customer sheet over matched stores and products."""
    return ru.customer_summary(ru.store_level(_resolved_detail(spark, d), tb.stores(spark, d)))


@register("recon_resolved_balance")
def recon_resolved_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per platform: quantity in total, reconciled and unmatched."""
    from shelfcheck.operators import resolve as rs

    return rs.balance(_resolved_sides(spark, d)[1])


# ---------------------------------------------------------------- stored sides

@register("recon_refreshed")
def recon_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """J1 + M6: the detail from stored side sums, after the jd side, first loaded from an export
    that lacked lines, has been refreshed alone."""
    from shelfcheck.plans.sides import SideSums

    li = tb.stock_lines(spark, d)
    lines = {s: li.where(F.col(c).isNotNull()).select("store_key", "product_key", F.col(c).alias("qty")) for s, c in rc.QTY.items()}
    sums = SideSums(spark, scratch(spark, "sides"))
    for side in ("book", "mt"):
        sums.refresh(side, lines[side])
    sums.refresh("jd", lines["jd"].where(F.col("product_key") % 2 == 0))
    sums.refresh("jd", lines["jd"])
    return sums.detail(tb.VIRTUAL_THRESHOLD)


@register("outlet_lookup")
def outlet_lookup(spark: SparkSession, d: str) -> DataFrame:
    """F4 of a given outlet (the live jd outlet with the smallest code) from stored guard inputs."""
    from shelfcheck.plans.sides import GuardStore

    outlets, stock, products, names = guard_inputs(spark, d)
    store = GuardStore(spark, scratch(spark, "guard"))
    store.fill(products, stock)
    own = (outlets.where(F.col("platform") == PLATFORM_JD)
           .agg(F.min_by(F.struct("customer_name", "outlet_code"), F.struct("outlet_code", "customer_name")).alias("o")).first()["o"])
    if own is None:
        return store.outlet_detail("", PLATFORM_JD, "", names)
    return store.outlet_detail(own["customer_name"], PLATFORM_JD, own["outlet_code"], names)


@register("stored_pull")
def stored_pull(spark: SparkSession, d: str) -> DataFrame:
    """One warehouse of pulled rows that are stored clustered by warehouse."""
    from shelfcheck.sources.pages import PullStore, inventory_rows

    store = PullStore(spark, scratch(spark, "pulls"))
    store.add(inventory_rows(_pages(spark, d)))
    return store.read("Brand#11").select("store_code", "store_warehouse", "product_code", "barcode", "stock_qty", "allocatable")


# ---------------------------------------------------------------- exports -> published tables -> reports

def _exports(spark: SparkSession, d: str, det: DataFrame | None = None) -> dict[str, DataFrame]:
    """The bound tables as the exports of every dataset but the book, under canonical names.
    ``det``: the quantities of ``keyed_detail`` when the caller already holds them."""
    held, st = det is not None, tb.stores(spark, d)
    det, codes = det if held else keyed_detail(spark, d), tb.product_codes(spark, d)
    names = tb.platform_names(codes).distinct()
    # A detail that is held is read per export, for its side only.
    jd, mt = (tb.platform_rows(det, codes, side if held else None).where(F.col("platform") == p).join(names, "platform_code", "left")
              for p, side in ((PLATFORM_JD, tb.JD), (PLATFORM_MT, tb.MT)))
    jd_out, mt_out = tb.jd_outlets(spark, d), tb.mt_outlets(spark, d)
    return {
        "jd_store_inventory": jd.select(F.col("store").alias("store_code"), F.col("platform_code").alias("merchant_product_code"),
                                        "barcode", "product_name", F.col("qty").alias("available_stock")),
        "meituan_store_inventory": mt.select(F.col("store").alias("store_id"), F.col("platform_code").alias("internal_sku_code"),
                                             "product_name", F.col("qty").alias("stock_qty")),
        "feishu_store_mapping": st.drop("store_key", "balance", "store_address"),
        "feishu_jd_outlet": jd_out, "feishu_meituan_outlet": mt_out, "jd_store": jd_out, "meituan_store": mt_out,
        "feishu_region_contact": st.select(F.col("customer_name").alias("primary_dealer"), F.col("province").alias("region")).distinct(),
    }


def _published(spark: SparkSession, d: str) -> str:
    """Exports with their source headers landed as CSV, loaded (I1-I13), the book as an API pull."""
    from shelfcheck.contracts import BOOK_API_SCHEMA, DATASET_TABLES, HEADER_MAPS, SOURCE_STEMS
    from shelfcheck.sources import ingest

    root, folder = scratch(spark, "tables"), scratch(spark, "exports")
    # Both platforms' exports and the book come from the same sums: reconciled once.
    det = keyed_detail(spark, d).select("store_key", "product_key", "bojun_qty", "jd_qty", "mt_qty").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for table, rows in _exports(spark, d, det).items():
            heads = {en: zh for zh, en in HEADER_MAPS[table].items() if en not in ("_blank", "extra_status") and
                     (table, en) != ("feishu_store_mapping", "store_address")}
            cells = rows.select(*[(F.col(en).cast("string") if en in rows.columns else F.lit(None).cast("string")).alias(zh)
                                  for en, zh in heads.items()])
            cells.write.option("header", True).csv(f"{folder}/{SOURCE_STEMS[table][0]}.csv")
        ingest.load_folder(spark, root, folder, "1", [k for k in DATASET_TABLES if k != "bojun"])
        st = tb.stores(spark, d)
        names = tb.products(spark, d).select(tb.product_code(), "product_name")
        book = tb.book_rows(det, st, barcodes=True, held=True).join(names, "product_code", "left").select(
            F.col("warehouse").alias("store_warehouse"), "store_code", "product_code", "barcode", "product_name", F.col("qty").alias("stock_qty"))
        declared = [x.split(" ") for x in BOOK_API_SCHEMA.split(", ")]
        book = book.select(*[(F.col(n) if n in book.columns else F.lit(None)).cast(t).alias(n) for n, t in declared])
        ingest.publish(spark, root, {"bojun_offline_inventory": book, "store_alias": tb.store_aliases(spark, d)}, "2")
    finally:
        det.unpersist()
    return root


def _report_sheet(spark: SparkSession, d: str, kind: str, sheet: str) -> DataFrame:
    from shelfcheck.plans.published import build_reports

    made = build_reports(spark, _published(spark, d), scratch(spark, "reports"), tb.VIRTUAL_THRESHOLD, (kind,))
    return spark.read.parquet(made[kind][sheet])


@register("report_customers")
def report_customers(spark: SparkSession, d: str) -> DataFrame:
    """K1 read back: the customer sheet over exports that were landed, loaded and published."""
    return _report_sheet(spark, d, "recon", "customer_summary")


@register("report_outlets")
def report_outlets(spark: SparkSession, d: str) -> DataFrame:
    """K2 read back: the outlet summary over the same published tables."""
    return _report_sheet(spark, d, "guard", "outlet_summary")


@register("payload_sections")
def payload_sections(spark: SparkSession, d: str) -> DataFrame:
    """K3 and K4 read back through their index files: rows per section."""
    from shelfcheck.plans import reports as rp
    from shelfcheck.sources.files import Files
    from shelfcheck.sources.ingest import stamp_snapshot

    out, snap = scratch(spark, "payload"), stamp_snapshot(spark)
    rp.write_payload(recon_inputs(spark, d), snap, out)
    rp.write_map_payload(_map_points(spark, d), snap, out)
    sections = {f"{kind}/{n}": p for kind in ("payload", "map") for n, p in Files(spark).get(f"{out}/{kind}/index.json").items()}
    counts = [spark.read.json(p).groupBy().count().select(F.lit(n).alias("section"), F.col("count").alias("rows")) for n, p in sections.items()]
    return reduce(DataFrame.unionByName, counts)


# ---------------------------------------------------------------- report orders as ranks

def ranked(df: DataFrame, order: list) -> DataFrame:
    """``df`` with its 1-based place in ``order``, numbered without gathering the rows."""
    from shelfcheck.operators.changes import ensure_ids

    return ensure_ids(df.withColumn("rank", F.lit(None).cast("bigint")), "rank", order)


@register("customer_rank")
def customer_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of every customer in the report."""
    return ranked(customer_summary(spark, d), ru.customer_order()).select("customer_name", "rank")


@register("store_rank")
def store_rank(spark: SparkSession, d: str) -> DataFrame:
    """S3: place of every store in the report."""
    return ranked(store_summary(spark, d), ru.store_order()).select("customer_name", "store_name", "rank")


@register("outlet_rank")
def outlet_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of every live outlet in the guard report."""
    from shelfcheck.operators import guard as gd

    return ranked(outlet_summary(spark, d), gd.summary_order()).select("platform", "outlet_code", "rank")


@register("unmatched_store_rank")
def unmatched_store_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of every unmatched store."""
    from shelfcheck.operators import match as mt

    return ranked(unmatched_stores(spark, d), mt.unmatched_store_order()).select("store_name", "rank")


@register("unmatched_product_rank")
def unmatched_product_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of every unmatched product."""
    from shelfcheck.operators import match as mt

    return ranked(unmatched_products(spark, d), mt.unmatched_product_order()).select("platform", "platform_code", "rank")


@register("map_point_rank")
def map_point_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of every map point."""
    from shelfcheck.operators import geo

    return ranked(map_points(spark, d), geo.point_order()).select("point_type", "name", "rank")


@register("outlet_share_rank")
def outlet_share_rank(spark: SparkSession, d: str) -> DataFrame:
    """S4, dashboard form: place of every live outlet by the unrounded share."""
    share = [(F.col("ok_cnt") / F.col("product_cnt")).asc(), *[F.col(c).asc_nulls_last() for c in ("customer_name", "platform", "outlet_name")]]
    return ranked(outlet_ranking(spark, d), share).select("platform", "outlet_code", "rank")


@register("listing_rank")
def listing_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of every mapping row in its listing; some rows lack the required field."""
    st = tb.stores(spark, d).select(F.col("store_key").alias("id"), F.when(F.col("store_key") % 4 > 0, F.col("province")).alias("name"))
    return ranked(st, [F.col("name").asc_nulls_last(), F.col("id").asc_nulls_last()]).select("id", "rank")


@register("geo_level_rank")
def geo_level_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of every level in the histogram."""
    return ranked(geo_levels(spark, d), [F.col("n").desc(), F.col("level").asc_nulls_last()]).select("level", "rank")


# ---------------------------------------------------------------- row expressions and keyed changes

@register("geocode_classes")
def geocode_classes(spark: SparkSession, d: str) -> DataFrame:
    """X8 + X9: landed geocoder answers, one per order, as cache rows: matches, no match, bad
    locations, API errors (some of them fatal) and texts that are no JSON."""
    from shelfcheck.contracts import FATAL_GEO_CODES
    from shelfcheck.operators.geo import classify_responses

    n = F.col("o_orderkey")
    kind = n % 6
    place = F.when(kind == 1, F.lit("nowhere")).otherwise(F.concat_ws(",", (n % 180).cast("string"), (n % 90).cast("string")))
    match = F.struct(place.alias("location"), n.cast("string").alias("adcode"), F.lit("").alias("formatted_address"),
                     F.col("o_orderpriority").alias("level"))
    answer = F.struct(
        F.when(kind.isin(3, 4), F.lit("0")).otherwise(F.lit("1")).alias("status"), F.lit("").alias("info"),
        F.when(kind == 4, F.lit(FATAL_GEO_CODES[0])).otherwise(F.lit("10000")).alias("infocode"),
        F.when(kind == 2, F.array_remove(F.array(match), match)).otherwise(F.array(match)).alias("geocodes"))
    body = F.when(kind == 5, F.lit("<html>busy</html>")).otherwise(F.to_json(answer))
    landed = tb.table(spark, d, "orders").select(n.cast("string").alias("address"), body.alias("body"),
                                                 F.col("o_orderdate").cast("timestamp").alias("received_at"))
    return classify_responses(landed).drop("updated_at", "formatted_address")


@register("current_versions")
def current_versions(spark: SparkSession, d: str) -> DataFrame:
    """M6 + I11 + I13: rows of the current versions after a run that loaded two tables, one that
    replaced one of them, and one that failed on its second table."""
    from pyspark.errors import PySparkException

    from shelfcheck.sources.ingest import current_path, publish, stamp_snapshot

    root, o, c = scratch(spark, "versions"), tb.table(spark, d, "orders"), tb.table(spark, d, "customer")
    publish(spark, root, {"orders": o.where(F.col("o_orderkey") % 2 == 0), "customer": c, "data_meta": stamp_snapshot(spark)}, "1")
    publish(spark, root, {"orders": o}, "2")
    broken = c.withColumn("c_name", F.when(F.col("c_custkey") >= 0, F.raise_error(F.lit("broken export"))))
    try:
        publish(spark, root, {"orders": o.where(F.col("o_orderkey") % 3 == 0), "customer": broken}, "3")
    except PySparkException:
        pass
    tables = [spark.read.parquet(current_path(spark, root, t)).groupBy().count().select(F.lit(t).alias("table_name"), F.col("count").alias("rows"))
              for t in ("orders", "customer", "data_meta")]
    return reduce(DataFrame.unionByName, tables)


@register("loaded_tables")
def loaded_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table loaded from exports with their source headers."""
    root = _published(spark, d)
    log = spark.read.parquet(f"{root}/_published").where(~F.col("table").isin("data_meta", "store_alias"))
    return log.select(F.col("table").alias("table_name"), "rows")


@register("logged_loads")
def logged_loads(spark: SparkSession, d: str) -> DataFrame:
    """K6 + S8: the newest 20 rows of a history to which an entry for every customer was logged."""
    from shelfcheck.plans.tables import load_history, log_rows

    c = tb.table(spark, d, "customer")
    runs = c.select(F.col("c_custkey").alias("id"), (F.lit("2024-01-01 00:00:00").cast("timestamp")
                    + F.make_dt_interval(hours=F.col("c_custkey").cast("int") % 1000)).alias("created_at"),
                    F.col("c_mktsegment").alias("label"), F.concat("c_name", F.lit(".csv")).alias("filename"),
                    (F.col("c_custkey") * 10).alias("size_bytes"), F.lit("success").alias("state"),
                    F.repeat(F.col("c_name"), 60).alias("message"),
                    F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lit("")).alias("operator"))
    path = scratch(spark, "history")
    log_rows(runs).write.parquet(path)
    return load_history(spark.read.parquet(path))


@register("scalar_texts")
def scalar_texts(spark: SparkSession, d: str) -> DataFrame:
    """X1, X2, X3, X5, X6, X8, X10 over orders and customers rendered as export text."""
    from shelfcheck.functions import scalars as sc

    o = tb.table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("　 "), F.col("o_orderkey").cast("string"), F.lit(".0 ")).alias("cell"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("word"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.concat_ws(",", (F.col("o_orderkey") % 180).cast("string"),
                    F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 90).cast("string"))).alias("place"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit("")).alias("nick"),
        F.concat(F.lit("id-"), F.col("o_custkey").cast("string"), F.lit("-long")).alias("ident"),
        (F.col("o_custkey") + 100000).cast("string").alias("adcode"),
        F.col("o_orderdate").cast("timestamp").alias("at"))
    loc = sc.parse_location("place")
    return o.select(
        "o_orderkey", sc.coerce_cell("cell", "text").alias("cell_text"), sc.coerce_cell("price", "int").alias("price_int"),
        sc.to_int("price").alias("price_trunc"), sc.strip_all("cell").alias("stripped"), sc.trim_spaces("word").alias("trimmed"),
        sc.minute_text("at").alias("minute"), sc.adcode_prefix("adcode", "province").alias("province"),
        sc.adcode_prefix("adcode", "city").alias("city"), loc["lng"].alias("lng"), loc["lat"].alias("lat"), loc["ok"].alias("located"),
        sc.display_name("nick", "ident").alias("shown"))


def _edits(spark: SparkSession, d: str):
    """(table, changes): customers as an edited table, events as its change log."""
    from shelfcheck.operators.changes import clean_changes

    c = tb.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("remark"))
    ev = tb.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    kind = F.pmod(F.col("event_id"), F.lit(7))
    op = (F.when(kind == 0, F.lit("insert")).when(kind == 1, F.lit("delete")).when(kind == 2, F.lit("upsert"))
          .when(kind == 3, F.lit(None)).otherwise(F.lit("update")))
    name = F.when(kind == 4, F.lit("  ")).otherwise(F.concat(F.lit(" n"), F.col("event_id").cast("string")))
    fields = F.when(kind == 5, F.create_map(F.lit("remark"), F.col("event_type"))).otherwise(
        F.create_map(F.lit("name"), name, F.lit("junk"), F.col("event_type")))
    changes = ev.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("bigint").alias("id"),
                        fields.alias("fields"))
    clean, rejects = clean_changes(changes, ["name", "remark"], "name")
    return c, clean, rejects


@register("edit_rejects")
def edit_rejects(spark: SparkSession, d: str) -> DataFrame:
    """F8: changes that are refused, with the reason."""
    return _edits(spark, d)[2].select("seq", "reason")


@register("edited_table")
def edited_table(spark: SparkSession, d: str) -> DataFrame:
    """M2: the table after all clean changes in sequence, which arrive in three batches: change
    files beside the stored rows, compacted after the second, merged on read."""
    from shelfcheck.operators.changes import edit_table

    rows, clean, _ = _edits(spark, d)
    third = (clean.agg(F.max("seq").alias("m")).first()["m"] or 0) // 3
    table = edit_table(spark, scratch(spark, "edits"), "id bigint, name string, remark string")
    table.replace(rows)
    seq = F.coalesce("seq", F.lit(0))
    table.append(clean.where(seq <= third))
    table.append(clean.where((seq > third) & (seq <= 2 * third)), compact_after=1)
    table.append(clean.where(seq > 2 * third))
    return table.read()


@register("edit_misses")
def edit_misses(spark: SparkSession, d: str) -> DataFrame:
    """M2: updates and deletes that found no row at their place in the sequence."""
    from shelfcheck.operators.changes import change_misses

    table, clean, _ = _edits(spark, d)
    return change_misses(table, clean).select("seq", "id", "op")


@register("user_flags")
def user_flags(spark: SparkSession, d: str) -> DataFrame:
    """M4: active flags set from error (off) and signup (on) events on the login profiles."""
    from shelfcheck.operators import changes as ch
    from shelfcheck.operators import logins as lg

    users = lg.profile_from_logins(tb.logins(spark, d))
    flags = tb.table(spark, d, "events").where(F.col("event_type").isin("error", "signup")).select(
        F.concat(F.lit("ou_"), F.col("user_id").cast("string")).alias("open_id"),
        (F.col("event_type") == "signup").alias("active"), F.col("event_id").alias("seq"))
    stamp = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return ch.set_active(users, flags, stamp)[0].select("open_id", "is_active", (F.col("updated_at") == stamp).alias("stamped"))


@register("missing_addresses")
def missing_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Distinct store names without an address, when the address table knows every
    third store and some names only blank or padded."""
    from shelfcheck.operators import match as mt

    st = tb.stores(spark, d)
    src = st.where(F.col("store_key") % 3 == 0).select(
        F.concat(F.lit("　"), "store_name", F.lit(" ")).alias("name"),
        F.when(F.col("store_key") % 2 == 0, F.col("store_address")).otherwise(F.lit(" ")).alias("address"),
        F.col("store_key").alias("line_no"))
    return mt.address_match_report(st, mt.address_book(src))[1]


@register("named_products")
def named_products(spark: SparkSession, d: str) -> DataFrame:
    """Names of a product per side fall back from book to jd to mt (max per side)."""
    lines = tb.stock_lines(spark, d).join(tb.products(spark, d), "product_key")
    even, third = F.col("product_key") % 2 == 0, F.col("product_key") % 3 == 0
    named = lines.select(
        "store_key", "product_key", "bojun_qty", "jd_qty", "mt_qty",
        F.when(even & F.col("bojun_qty").isNotNull(), F.concat(F.lit("b "), "product_name")).alias("book_name"),
        F.when(third & F.col("jd_qty").isNotNull(), F.concat(F.lit("j "), "product_name")).alias("jd_name"),
        F.when(F.col("mt_qty").isNotNull(), F.concat(F.lit("m "), "product_name")).alias("mt_name"))
    return rc.reconcile(named, tb.VIRTUAL_THRESHOLD).select("store_key", "product_key", "product_name")


@register("detail_rank")
def detail_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of every detail row in the report."""
    order = [F.col(c).asc_nulls_last() for c in ("customer_name", "store_name", "product_code")]
    return ranked(recon_detail(spark, d), order).select("store_name", "product_code", "rank")


@register("listed_rank")
def listed_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of every listed guard row (short first, which is the order of the gap)."""
    order = [F.col(c).asc_nulls_last() for c in ("customer_name", "platform", "outlet_name", "gap", "product_code")]
    return ranked(guard_listed_detail(spark, d), order).select("platform", "outlet_code", "product_code", "rank")


# ---------------------------------------------------------------- ingest over the tables as export text

@register("typed_values")
def typed_values(spark: SparkSession, d: str) -> DataFrame:
    """I8 + I9: orders exported as padded text, typed again."""
    from shelfcheck.sources.ingest import column_stats, format_values, infer_types

    o = tb.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    text = o.select(*[F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("　")).alias(n) for c, n in (
        ("o_orderkey", "order_no"), ("o_custkey", "cust"), ("o_totalprice", "price"), ("o_orderpriority", "word"),
        ("o_orderdate", "placed"))], F.lit("").alias("empty"))
    return format_values(text, infer_types(text, column_stats(text)))


@register("promoted_columns")
def promoted_columns(spark: SparkSession, d: str) -> DataFrame:
    """Of two text columns the one that holds integers alone becomes bigint."""
    from shelfcheck.sources.ingest import promote_if_all_integer

    text = tb.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, (-F.col("o_custkey")).cast("string")).alias("whole"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("12a")).otherwise(F.col("o_custkey").cast("string")).alias("mixed"))
    return promote_if_all_integer(promote_if_all_integer(text, "whole")[0], "mixed")[0]


@register("merged_types")
def merged_types(spark: SparkSession, d: str) -> DataFrame:
    """I8 from merged profiles: an export of orders in three deliveries, of which the last turns one
    column from whole numbers to fractions and another from dates to text."""
    from shelfcheck.sources.profiles import ProfileStore, typed_export

    folder, store = scratch(spark, "export"), ProfileStore(spark, scratch(spark, "profiles"))
    o, last = tb.table(spark, d, "orders"), F.col("o_orderkey") % 3 == 2
    text = o.select(
        (F.col("o_orderkey") % 3).alias("part"), F.col("o_orderkey").cast("string").alias("order_no"),
        F.concat(F.col("o_custkey").cast("string"), F.when(last, F.lit(".5")).otherwise(F.lit(""))).alias("cust"),
        F.col("o_totalprice").cast("string").alias("price"), F.col("o_custkey").cast("string").alias("rank"),
        F.when(last, F.col("o_orderpriority")).otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("placed"))
    types = {}
    for k in range(3):
        text.where(F.col("part") == k).drop("part").write.option("header", True).mode("append").csv(folder)
        types = typed_export(spark, folder, store)[1]
    return spark.createDataFrame(list(types.items()), "column_name string, inferred_type string")


@register("imported_mapping")
def imported_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The store export imported again, with rows that have no key and an unknown column."""
    from shelfcheck.contracts import EDITED_TABLES
    from shelfcheck.sources.ingest import import_table

    out = store_export(spark, d).withColumn("序号", F.concat(F.col("内部编码"), F.lit(".9"))).withColumn("unknown", F.lit("x"))
    heads = {en: zh for en, zh, _ in EDITED_TABLES["mapping"]["columns"]}
    blank = out.select(*[F.when(F.lit(c in [heads[k] for k in EDITED_TABLES["mapping"]["key_fields"]]), F.lit(" "))
                         .otherwise(F.col(c)).alias(c) for c in out.columns])
    rows, _ = import_table(out.unionByName(blank), "mapping")
    return rows.select("seq_no", "store_name", "customer_name", "jd_id", "jd_enable_status")


def _pages(spark: SparkSession, d: str, size: int = 50, faults: bool = True) -> DataFrame:
    """API pages of one pull per brand, made of parts, a page for every ``size`` of them. With
    ``faults`` every seventh page of a pull is missing and every fifth was rejected."""
    from shelfcheck.contracts import PAGE_OK_CODE, PAGE_QTY_FIELDS, PAGE_TEXT_FIELDS

    p = tb.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    key = F.col("p_partkey").cast("string")
    other = F.col("p_partkey") % 2  # the API's two casings
    values = {"store_code": key, "store_warehouse": F.col("p_brand"), "product_code": key,
              "barcode": F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("69"), key)).otherwise(F.lit(""))}
    entries = []
    for c, names in PAGE_TEXT_FIELDS.items():
        entries += [F.when(other == 1, names[0]).otherwise(names[1]), values[c]]
    for f in PAGE_QTY_FIELDS.values():
        entries += [F.lit(f), F.concat(F.col("p_size").cast("string"), F.lit(".7"))]
    paged = p.select(F.col("p_brand").alias("pull"), (F.floor(F.col("p_partkey") / size) + 1).alias("current"),
                     F.create_map(*entries).alias("rec"))
    pages = paged.groupBy("pull", "current").agg(F.collect_list("rec").alias("records"))  # at most ``size`` a page
    last = (p.agg(F.max("p_partkey")).first()[0] or 0) // size + 1  # one number
    rejected, gone = (F.col("current") % n == 0 if faults else F.lit(False) for n in (5, 7))
    code = F.when(rejected, 500).otherwise(PAGE_OK_CODE).cast("bigint")
    data = F.struct("current", F.lit(size).cast("bigint").alias("pageSize"), F.lit(0).cast("bigint").alias("total"),
                    F.lit(last).cast("bigint").alias("totalPage"), "records")
    return (pages.where(~gone)
            .select("pull", F.concat("pull", F.lit("/"), F.col("current").cast("string")).alias("source_file"),
                    F.struct(code.alias("code"), F.lit("").alias("msg"), data.alias("data")).alias("page")))


@register("pulled_rows")
def pulled_rows(spark: SparkSession, d: str) -> DataFrame:
    """I14 + I17 + X1: records of accepted pages as book rows, one warehouse."""
    from shelfcheck.sources.pages import filter_pull, inventory_rows

    return filter_pull(inventory_rows(_pages(spark, d)), store="Brand#11").select(
        "store_code", "store_warehouse", "product_code", "barcode", "stock_qty", "allocatable")


def _land_pages(spark: SparkSession, d: str, pages: DataFrame) -> str:
    """Pages as the files a pull leaves: a folder per pull, a file per page."""
    landing = scratch(spark, "pulls")
    named = pages.select(F.translate("pull", "#", "-").alias("pull"), F.to_json("page").alias("value"))
    named.write.option("maxRecordsPerFile", 1).partitionBy("pull").text(landing)
    return landing


@register("landed_rows")
def landed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same rows, from landed page files through the data source."""
    from shelfcheck.sources.page_source import read_landing
    from shelfcheck.sources.pages import filter_pull, inventory_rows

    landing = _land_pages(spark, d, _pages(spark, d).where(F.col("pull") == "Brand#11"))
    return filter_pull(inventory_rows(read_landing(spark, landing)), store="Brand#11").select(
        "store_code", "store_warehouse", "product_code", "barcode", "stock_qty", "allocatable")


@register("published_pull")
def published_pull(spark: SparkSession, d: str) -> DataFrame:
    """I14 + I15 + I11 as a stream: of three pulls with a page for every 500 parts, the newest lacks
    its last page, so the one before it is published last."""
    from shelfcheck.sources.ingest import current_path
    from shelfcheck.streaming.pages import TABLE, run_pull_stream

    pages = _pages(spark, d, size=500, faults=False).where(F.col("pull").isin("Brand#11", "Brand#12", "Brand#13"))
    gap = (F.col("pull") == "Brand#13") & (F.col("page.data.current") == F.col("page.data.totalPage"))
    root = scratch(spark, "published")
    run_pull_stream(spark, _land_pages(spark, d, pages.where(~gap)), root, f"{root}/_ckpt").awaitTermination()
    rows = spark.read.parquet(current_path(spark, root, TABLE))
    return rows.select("store_code", "store_warehouse", "product_code", "barcode", "stock_qty", "allocatable")


@register("missing_pages")
def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that did not land or were rejected."""
    from shelfcheck.sources.pages import page_completeness

    return page_completeness(_pages(spark, d))


@register("load_messages")
def load_messages(spark: SparkSession, d: str) -> DataFrame:
    """K7: the message of load runs, their output lines made of orders."""
    from shelfcheck.plans.tables import load_log_message

    o = tb.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    n = F.col("o_custkey").cast("string")
    runs = o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 2 == 0).alias("ok"), F.array(
        F.lit("start"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(n, F.lit(" rows, 8 cols"))).otherwise(F.lit("x")),
        F.col("o_orderpriority"), F.lit("  "), F.lit("Warning: last")).alias("lines"))
    return load_log_message(runs)


@register("one_profile")
def one_profile(spark: SparkSession, d: str) -> DataFrame:
    """the profile of one user."""
    from shelfcheck.operators import logins as lg

    return lg.profile(lg.profile_from_logins(tb.logins(spark, d)), "ou_7")
