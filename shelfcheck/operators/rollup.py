"""Roll the reconciliation detail up to store and customer.

All measures are sums (with row filters), so they are decomposable: the detail is
reduced once per store (shuffle on the store key, map-side partial aggregation), and
the customer level is summed from the store rows. No ``count(DISTINCT ...)`` is
needed: after the store level each (customer, store) is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.contracts import FLAG_VIRTUAL
from shelfcheck.functions.rates import group_rate, row_rate
from shelfcheck.operators.common import is_active_store

PLATFORMS = ("jd", "mt")


def customer_order() -> list:
    """S2."""
    return [(F.abs("jd_diff") + F.abs("mt_diff")).desc(), F.col("customer_name").asc_nulls_last()]


def store_order() -> list:
    """S3."""
    return [F.col("customer_name").asc_nulls_last(), (F.abs("jd_diff") + F.abs("mt_diff")).desc(),
            F.col("store_name").asc_nulls_last()]


CARRIED = ["bojun_raw"] + [f"{p}_{m}" for p in PLATFORMS for m in ("raw", "net", "cmp", "base")]


def _partial_sums() -> list:
    """Sums over detail rows that every level carries (all decomposable)."""
    book = F.col("bojun_qty")
    out = [F.sum(book).alias("bojun_raw")]
    for p in PLATFORMS:
        q = F.col(f"{p}_qty")
        comparable = (book > 0) & q.isNotNull()
        out += [
            F.sum(q).alias(f"{p}_raw"),
            # A3: net diff only over rows with book stock that are not virtual stock.
            F.sum(F.when(book.isNotNull() & (F.col("flag") != FLAG_VIRTUAL),
                         F.col(f"{p}_diff"))).alias(f"{p}_net"),
            # A4: compare only rows with positive book stock that the platform lists.
            F.sum(F.when(comparable, F.least(q, book))).alias(f"{p}_cmp"),
            F.sum(F.when(comparable, book)).alias(f"{p}_base"),
        ]
    return out


def _resum() -> list:
    """Re-aggregate carried sums one level up."""
    return [F.sum(c).alias(c) for c in CARRIED]


def store_partials(detail: DataFrame) -> DataFrame:
    """Per store_key partial sums of the detail (one shuffle on a long key)."""
    return detail.groupBy("store_key").agg(*_partial_sums())


def _finish(df: DataFrame) -> DataFrame:
    """Turn carried sums into the reported measures."""
    cols = {"bojun_sum": F.coalesce("bojun_raw", F.lit(0))}
    for p in PLATFORMS:
        cols[f"{p}_sum"] = F.coalesce(f"{p}_raw", F.lit(0))
        cols[f"{p}_diff"] = F.coalesce(f"{p}_net", F.lit(0))
        cols[f"{p}_rate"] = group_rate(f"{p}_cmp", f"{p}_base")
    return df.withColumns(cols)


def store_level(detail: DataFrame, stores: DataFrame, partials: DataFrame | None = None) -> DataFrame:
    """Per (customer, store) carried sums, named through the store dimension.

    ``partials``: ``store_partials(detail)`` when the caller already holds it (a report
    that also derives other per-store facts from it). The detail is reduced per store key
    first, so names are joined to, and summed over, one row per store.
    """
    partials = store_partials(detail) if partials is None else partials
    named = partials.join(stores.select("store_key", "customer_name", "store_name"), "store_key", "left")
    return named.groupBy("customer_name", "store_name").agg(*_resum())


def customer_summary(store_rows: DataFrame) -> DataFrame:
    """A1 (+A3, A4) from store-level rows; S2 order."""
    agg = store_rows.groupBy("customer_name").agg(
        F.count("store_name").alias("store_cnt"), *_resum())
    out = _finish(agg).select(
        "customer_name", "store_cnt", "bojun_sum", "jd_sum", "jd_diff", "jd_rate",
        "mt_sum", "mt_diff", "mt_rate",
    )
    return out.orderBy(*customer_order())


def store_ids(stores: DataFrame) -> DataFrame:
    """One row per store name among active stores: max(jd_id), max(meituan_id) as text."""
    return (
        stores.where(is_active_store("remark"))
        .groupBy("store_name")
        .agg(F.max(F.col("jd_id").cast("string")).alias("jd_id"),
             F.max(F.col("meituan_id").cast("string")).alias("meituan_id"))
    )


def attach_store_ids(df: DataFrame, stores: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Left join the per-name ids; the right side is unique per name, so totals hold.

    ``ids``: ``store_ids(stores)`` when the caller already holds it (shared by sheets).
    """
    ids = ids if ids is not None else store_ids(stores)
    return df.join(ids, "store_name", "left")


def store_summary(store_rows: DataFrame, stores: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A2: per (customer, store) with platform ids; S3 order."""
    out = _finish(attach_store_ids(store_rows, stores, ids)).select(
        "customer_name", "store_name", "bojun_sum", "jd_id", "jd_sum", "jd_diff", "jd_rate",
        "meituan_id", "mt_sum", "mt_diff", "mt_rate",
    )
    return out.orderBy(*store_order())


def detail_report(named_detail: DataFrame, stores: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """K1 detail sheet: detail + store ids + A5 row rates; S1 order. Rows named through a store
    dimension that holds the ids already (``attach_dims``) need no join for them."""
    out = named_detail if "jd_id" in named_detail.columns else attach_store_ids(named_detail, stores, ids)
    out = out.withColumns({"jd_rate": row_rate("jd_qty", "bojun_qty"),
                           "mt_rate": row_rate("mt_qty", "bojun_qty")})
    return out.select(
        "customer_name", "store_name", "product_code", "product_name", "bojun_qty", "jd_id",
        "jd_qty", "jd_diff", "jd_rate", "meituan_id", "mt_qty", "mt_diff", "mt_rate", "flag",
    ).orderBy(
        F.col("customer_name").asc_nulls_last(), F.col("store_name").asc_nulls_last(),
        F.col("product_code").asc_nulls_last(),
    )


def inactive_count(stores: DataFrame) -> DataFrame:
    """Dimension rows (not distinct stores) that are not active."""
    return stores.agg(F.count_if(~is_active_store("remark")).alias("inactive"))
