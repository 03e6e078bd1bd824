"""K1-K4: write the recon and guard reports as datasets.

Each report computes the reconciliation detail once, persists it (memory, spilling to
disk; a lost block is recomputed from lineage) and writes one folder per sheet, in
the sheet's column order, in parallel from the executors. Nothing passes through the
driver. Sheets keep their report order: each folder is written from a sorted frame,
so its part files are range-partitioned in order.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.contracts import FLAGS
from shelfcheck.operators import guard as gd
from shelfcheck.operators import match as mt
from shelfcheck.operators import reconcile as rc
from shelfcheck.operators import rollup as ru
from shelfcheck.sources.files import Files


@dataclass
class ReconInputs:
    """Everything the recon / guard reports read."""

    keyed_detail: DataFrame          # J1 keyed by (store_key, product_key)
    stores: DataFrame                # store mapping (v_dim_store shape, with store_key)
    products: DataFrame | None       # product catalogue (product_key, product_name)
    book_warehouses: DataFrame       # (warehouse, store_code) seen on the book side
    platform_rows: DataFrame         # J6 input rows (platform, platform_code, store, ...)
    book_products: DataFrame         # (product_code, barcode) of the book side
    outlets: DataFrame               # live outlets (customer_name, platform, outlet_code, outlet_name)
    outlet_stock: DataFrame          # (platform, outlet_code, product_code, outlet_qty)
    store_partials: DataFrame | None = None  # per store_key sums of the detail (rollup.store_partials)
    aliases: DataFrame | None = None         # store alias table (alias, store_name) for J4
    platform_names: DataFrame | None = None  # (platform_code, product_name) for J7
    shared: tuple[DataFrame, ...] = ()       # further small frames several sheets read


def _write(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def _same(df: DataFrame) -> DataFrame:
    return df


def recon_sheets(inp: ReconInputs, detail: DataFrame, keep=_same) -> dict[str, DataFrame]:
    """The five recon sheets. ``keep`` marks a frame that several sheets read (the
    report persists it for its duration)."""
    store_rows = keep(ru.store_level(detail, inp.stores, inp.store_partials))
    ids = keep(ru.store_ids(inp.stores))  # J2 ids per store name: store and detail sheets
    # The ids join the store dimension, so that a detail row meets one dimension for both.
    with_ids = inp.stores.select("store_key", "customer_name", "store_name").join(ids, "store_name", "left")
    named = rc.attach_dims(detail, with_ids, inp.products, ("jd_id", "meituan_id"))
    unmatched = mt.unmatched_rows(inp.platform_rows, mt.product_mapping(inp.platform_rows, inp.book_products))
    names = inp.platform_names
    if names is None and inp.products is not None:
        names = inp.products.select(F.col("product_key").cast("string").alias("platform_code"),
                                    "product_name")
    return {
        "customer_summary": ru.customer_summary(store_rows),
        "store_summary": ru.store_summary(store_rows, inp.stores, ids),
        "detail": ru.detail_report(named, inp.stores, ids),
        "unmatched_stores": mt.unmatched_stores(inp.stores, inp.book_warehouses, inp.aliases),
        "unmatched_products": mt.unmatched_products(unmatched, names),
    }


def guard_sheets(inp: ReconInputs, detail: DataFrame, keep=_same) -> dict[str, DataFrame]:
    """The two guard sheets; dealer totals and listed pairs feed both (``keep``)."""
    book = rc.attach_dims(detail, inp.stores).select("customer_name", "product_code", "bojun_qty")
    products = keep(gd.dealer_products(book))
    names = None
    if inp.products is not None:
        names = inp.products.select(F.col("product_key").cast("string").alias("product_code"),
                                    "product_name")
    # listed pairs (outlet stock joined to dealer totals) feed both sheets
    listed = keep(gd.listed_pairs(inp.outlets, inp.outlet_stock, products))
    return {
        "outlet_summary": gd.outlet_summary(inp.outlets, inp.outlet_stock, products, listed),
        "listed_detail": gd.listed_detail(inp.outlets, inp.outlet_stock, products, names, listed),
    }


BUILDERS = {"recon": recon_sheets, "guard": guard_sheets}


def write_reports(kinds: tuple[str, ...], inp: ReconInputs, out_dir: str, fmt: str = "parquet",
                  timings: dict[str, float] | None = None, concurrent: bool = True) -> dict[str, dict[str, str]]:
    """K1 (``recon``) and / or K2 (``guard``): one dataset folder per sheet.

    The detail is computed once for all requested reports (the two are rebuilt together
    after every data change). Sheets are independent outputs: with ``concurrent`` their
    writes are submitted as parallel Spark jobs from driver threads, so the scheduler
    overlaps their stages instead of running small jobs one after another. Optional
    ``timings`` receives seconds until each report's last sheet finished, and the total.
    """
    import time
    from concurrent.futures import ThreadPoolExecutor

    bad = [k for k in kinds if k not in BUILDERS]
    if bad:
        raise ValueError(f"unknown report kind {bad}")
    t0 = time.time()
    # The detail feeds every sheet; the two small dimensions feed several joins each;
    # builders mark further shared frames through ``keep``. Persisted blocks that are
    # lost with an executor are recomputed from lineage.
    detail = inp.keyed_detail.persist(StorageLevel.MEMORY_AND_DISK)
    held = [inp.stores.persist(StorageLevel.MEMORY_AND_DISK),
            inp.outlets.persist(StorageLevel.MEMORY_AND_DISK)]
    if inp.store_partials is not None:
        # one row per store: store summaries and book warehouses both read it
        held.append(inp.store_partials.persist(StorageLevel.MEMORY_AND_DISK))
    held += [df.persist(StorageLevel.MEMORY_AND_DISK) for df in inp.shared]

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    pool = ThreadPoolExecutor(max_workers=16) if concurrent else None
    try:
        # Materialise the shared detail on the cluster while the driver builds the
        # sheet plans (plan construction is driver work; the detail is executor work).
        ready = pool.submit(detail.count) if pool is not None else None
        jobs = []
        for kind in kinds:
            for name, df in BUILDERS[kind](inp, detail, keep).items():
                jobs.append((kind, name, df, os.path.join(out_dir, kind, name)))
        done: dict[str, float] = {}

        def run(job):
            kind, _, df, path = job
            _write(df, path, fmt)
            done[kind] = max(done.get(kind, 0.0), time.time() - t0)

        if pool is not None:
            ready.result()  # every sheet reads the detail: fan out once it is cached
            list(pool.map(run, jobs))
        else:
            for job in jobs:
                run(job)
        if timings is not None:
            timings.update({k: round(v, 3) for k, v in done.items()})
            timings["total"] = round(time.time() - t0, 3)
        out: dict[str, dict[str, str]] = {}
        for kind, name, _, path in jobs:
            out.setdefault(kind, {})[name] = path
        return out
    finally:
        if pool is not None:
            pool.shutdown(wait=True)
        detail.unpersist()
        for df in held:
            df.unpersist()


def write_report(kind: str, inp: ReconInputs, out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """K1 (``recon``) or K2 (``guard``) alone."""
    return write_reports((kind,), inp, out_dir, fmt)[kind]


def _generated_at(snapshot: DataFrame) -> DataFrame:
    """One row: the snapshot's load time to the minute, now where there is none."""
    return snapshot.agg(F.max("loaded_at").alias("loaded_at")).select(
        F.date_format(F.coalesce("loaded_at", F.current_timestamp()), "yyyy-MM-dd HH:mm").alias("generated_at"))


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """The columns of frames of one row as one row, without joining them."""
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def payload_meta(generated_at: DataFrame, stores: DataFrame) -> DataFrame:
    """K3 meta section: generated_at (minute text), flag list, inactive store rows.

    ``generated_at``: the one-row snapshot table (I13) or any frame with ``loaded_at``.
    """
    flags = F.array(*[F.lit(f) for f in FLAGS]).alias("flags")
    return _side_by_side(_generated_at(generated_at), ru.inactive_count(stores)).select("generated_at", flags, "inactive")


def write_payload(inp: ReconInputs, snapshot: DataFrame, out_dir: str) -> dict[str, str]:
    """K3: the dashboard document as JSON sections (meta, detail, unStores, unProducts,
    outletGuard); detail rows carry the flag index (F5) instead of the flag text."""
    detail = inp.keyed_detail.persist(StorageLevel.MEMORY_AND_DISK)
    held = [detail]

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    try:
        named = rc.attach_dims(detail, inp.stores, inp.products)
        sheets = recon_sheets(inp, detail, keep)
        guard = guard_sheets(inp, detail, keep)
        sections = {
            "meta": payload_meta(snapshot, inp.stores),
            "detail": named.select(*rc.DETAIL_COLUMNS[:-1], rc.flag_index("flag").alias("flag_idx"))
            .orderBy(F.col("customer_name").asc_nulls_last(), F.col("store_name").asc_nulls_last(),
                     F.col("product_code").asc_nulls_last()),
            "unStores": sheets["unmatched_stores"],
            "unProducts": sheets["unmatched_products"],
            "outletGuard": gd.outlet_ranking(guard["outlet_summary"]),
        }
        return _write_sections(sections, os.path.join(out_dir, "payload"))
    finally:
        for df in held:
            df.unpersist()


def _write_sections(sections: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each section as JSON lines, and ``index.json``, written last, which makes one document of
    them: section -> folder."""
    files, paths = Files(next(iter(sections.values())).sparkSession), {}
    files.delete(os.path.join(folder, "index.json"))
    for name, df in sections.items():
        paths[name] = os.path.join(folder, name)
        df.write.mode("overwrite").json(paths[name])
    files.put(os.path.join(folder, "index.json"), paths)
    return paths


def write_map_payload(points: DataFrame, snapshot: DataFrame, out_dir: str) -> dict[str, str]:
    """K4: map document as JSON sections: meta (generated_at, types, total, located) and
    points (type index F6 instead of the type text; unlocated points keep null lng/lat)."""
    from shelfcheck.contracts import POINT_TYPES
    from shelfcheck.operators import geo

    pts = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        meta = _side_by_side(_generated_at(snapshot), geo.located_count(pts)).select(
            "generated_at", F.array(*[F.lit(t) for t in POINT_TYPES]).alias("types"), "total", "located")
        body = pts.select(geo.point_type_index().alias("type_idx"), "name", "customer_name", "province",
                          "city", "address", "lng", "lat", "jd_sku_cnt", "mt_sku_cnt", "adcode")
        return _write_sections({"meta": meta, "points": body}, os.path.join(out_dir, "map"))
    finally:
        pts.unpersist()
