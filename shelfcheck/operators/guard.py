"""Does each live online outlet cover its dealer's book stock?

Definition (per live outlet o of dealer c and each product p the dealer holds in book):
    offline_qty = dealer's total book stock of p
    outlet_qty  = o's platform stock of p (null when o does not list p)
    gap         = coalesce(outlet_qty, 0) - offline_qty;  is_ok = gap >= 0

Materialising that relation means every outlet x every product of its dealer, i.e.
all pairs inside a dealer group. We never build it for all outlets. Instead:

* listed pairs (an outlet's own stock rows joined to its dealer's totals) are linear
  in the platform stock;
* an unlisted product is ok exactly when offline_qty <= 0, so per outlet
      ok_cnt = ok among listed + (dealer products with offline <= 0
                                  - listed products with offline <= 0)
  and product_cnt = the dealer's product count. Both come from per-dealer counts.
* the full per-product view (with unlisted products) is produced for one outlet at
  a time (F4), which is linear in that dealer's product count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.contracts import GUARD_MET, GUARD_SHORT, PLATFORM_JD, PLATFORM_MT
from shelfcheck.functions.rates import pct_tenths
from shelfcheck.operators.common import live_jd_outlets, live_mt_outlets

OUTLET_KEYS = ["customer_name", "platform", "outlet_code", "outlet_name"]


def dealer_products(detail: DataFrame) -> DataFrame:
    """Per (customer, product) the dealer's total book stock, over rows with book stock.

    ``detail`` needs customer_name, product_code, bojun_qty; names are attached later
    (``with_product_names``) only where a report shows them.
    """
    return (
        detail.where(F.col("bojun_qty").isNotNull())
        .groupBy("customer_name", "product_code")
        .agg(F.sum("bojun_qty").alias("offline_qty"))
    )


def with_product_names(df: DataFrame, names: DataFrame | None) -> DataFrame:
    """Attach product_name by product_code (names unique per code) or a null column."""
    if names is None:
        return df.withColumn("product_name", F.lit(None).cast("string"))
    return df.join(names.select("product_code", "product_name"), "product_code", "left")


def live_outlets(jd_outlets: DataFrame, mt_outlets: DataFrame) -> DataFrame:
    """F2 on both outlet lists, unified to (customer_name, platform, outlet_code, outlet_name)."""
    jd = live_jd_outlets(jd_outlets).select(
        F.col("dealer").alias("customer_name"), F.lit(PLATFORM_JD).alias("platform"),
        F.col("store_code").alias("outlet_code"), F.col("store_name").alias("outlet_name"))
    mt = live_mt_outlets(mt_outlets).select(
        F.col("dealer").alias("customer_name"), F.lit(PLATFORM_MT).alias("platform"),
        F.col("store_id").alias("outlet_code"), F.col("store_name").alias("outlet_name"))
    return jd.unionByName(mt).where(F.col("customer_name").isNotNull()).dropDuplicates(OUTLET_KEYS)


def outlet_stock(jd_stock: DataFrame | None = None, mt_stock: DataFrame | None = None,
                 stacked: DataFrame | None = None, assume_unique: bool = False) -> DataFrame:
    """Platform stock per (platform, outlet_code, product_code), unique per key.

    Inputs carry (store_code | store_id, product_code, qty), or ``stacked`` already has
    (platform, outlet_code, product_code, qty). ``assume_unique`` skips the summing
    shuffle when the caller's rows are already one per key (an aggregate's output).
    """
    parts = [] if stacked is None else [stacked.select("platform", "outlet_code", "product_code", "qty")]
    if jd_stock is not None:
        parts.append(jd_stock.select(F.lit(PLATFORM_JD).alias("platform"),
                                     F.col("store_code").alias("outlet_code"), "product_code", "qty"))
    if mt_stock is not None:
        parts.append(mt_stock.select(F.lit(PLATFORM_MT).alias("platform"),
                                     F.col("store_id").alias("outlet_code"), "product_code", "qty"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    if assume_unique:
        return both.withColumnRenamed("qty", "outlet_qty")
    return (both.groupBy("platform", "outlet_code", "product_code")
            .agg(F.sum("qty").alias("outlet_qty")))


def _with_gap(df: DataFrame) -> DataFrame:
    gap = F.coalesce(F.col("outlet_qty"), F.lit(0)) - F.col("offline_qty")
    return df.select("*", gap.alias("gap"), (gap >= 0).alias("is_ok"))


def listed_pairs(outlets: DataFrame, stock: DataFrame, products: DataFrame) -> DataFrame:
    """Guard rows for products an outlet lists and its dealer holds (linear join)."""
    with_dealer = stock.join(outlets, ["platform", "outlet_code"])
    return _with_gap(with_dealer.join(products, ["customer_name", "product_code"]))


def outlet_summary(outlets: DataFrame, stock: DataFrame, products: DataFrame,
                   listed_rows: DataFrame | None = None) -> DataFrame:
    """product_cnt, ok_cnt, bad_cnt, ok_rate per live outlet; report order.

    The per-outlet side of every join here has at most one row per outlet; nothing large
    is shuffled beyond the listed pairs themselves. ``listed_rows``: ``listed_pairs(...)`` when the
    caller already holds it (the guard report shares it with the detail sheet).
    """
    per_dealer = products.groupBy("customer_name").agg(
        F.count(F.lit(1)).alias("product_cnt"),
        F.count_if(F.col("offline_qty") <= 0).alias("nonpos_cnt"),
    )
    if listed_rows is None:
        listed_rows = listed_pairs(outlets, stock, products)
    listed = listed_rows.groupBy(*OUTLET_KEYS).agg(
        F.count_if(F.col("is_ok")).alias("listed_ok"),
        F.count_if(F.col("offline_qty") <= 0).alias("listed_nonpos"),
    )
    out = (
        per_dealer.join(outlets, "customer_name")  # outlets without dealer products drop out
        .join(listed, OUTLET_KEYS, "left")
        .withColumn("ok_cnt", F.col("nonpos_cnt") + F.coalesce("listed_ok", F.lit(0))
                    - F.coalesce("listed_nonpos", F.lit(0)))
        .withColumns({"bad_cnt": F.col("product_cnt") - F.col("ok_cnt"),
                      "ok_rate": pct_tenths("ok_cnt", "product_cnt")})
    )
    return out.select(*_report_cols(), "product_cnt", "ok_cnt", "bad_cnt", "ok_rate").orderBy(*summary_order())


def summary_order() -> list:
    """S4."""
    return [F.col("ok_rate").asc_nulls_last(), F.col("customer_name").asc_nulls_last(),
            F.col("platform").asc_nulls_last(), F.col("outlet_name").asc_nulls_last()]


def _report_cols():
    return ["customer_name", "platform", "outlet_name", "outlet_code"]


def outlet_ranking(summary: DataFrame) -> DataFrame:
    """S4, dashboard form: worst first by the *unrounded* ok share."""
    return summary.select(
        "customer_name", "platform", "outlet_code", "outlet_name", "product_cnt", "ok_cnt"
    ).orderBy((F.col("ok_cnt") / F.col("product_cnt")).asc(), F.col("customer_name").asc_nulls_last(),
              F.col("platform").asc_nulls_last(), F.col("outlet_name").asc_nulls_last())


def guard_status(is_ok: str = "is_ok"):
    """met when is_ok, otherwise (false or null) short."""
    return F.when(F.col(is_ok), F.lit(GUARD_MET)).otherwise(F.lit(GUARD_SHORT))


def listed_detail(outlets: DataFrame, stock: DataFrame, products: DataFrame,
                  names: DataFrame | None = None, listed_rows: DataFrame | None = None) -> DataFrame:
    """K2 detail for listed products; S5 order (short first, largest shortage first)."""
    if listed_rows is None:
        listed_rows = listed_pairs(outlets, stock, products)
    rows = with_product_names(listed_rows, names)
    return rows.orderBy(
        F.col("customer_name").asc_nulls_last(), F.col("platform").asc_nulls_last(),
        F.col("outlet_name").asc_nulls_last(), F.col("is_ok").asc_nulls_last(),
        F.col("gap").asc_nulls_last(), F.col("product_code").asc_nulls_last(),
    ).select(
        *_report_cols(), "product_code", "product_name", "offline_qty", "outlet_qty", "gap",
        guard_status().alias("status"),
    )


def worst_outlet(summary: DataFrame) -> DataFrame:
    """One row (customer_name, platform, outlet_code): the first in report order."""
    first = F.struct(F.col("ok_rate").isNull(), "ok_rate", "customer_name", "platform", "outlet_name")
    return summary.agg(F.min_by(F.struct("customer_name", "platform", "outlet_code"), first).alias("w")).where(
        F.col("w").isNotNull()).select("w.*")


def outlet_detail(chosen: DataFrame, stock: DataFrame, products: DataFrame,
                  names: DataFrame | None = None) -> DataFrame:
    """every product of one outlet's dealer with its guard values; S5 order.

    ``chosen``: one row (customer_name, platform, outlet_code), given or computed; it is
    joined, so choosing it needs no separate job.
    """
    chosen = F.broadcast(chosen)  # one row
    prods = products.join(chosen.select("customer_name"), "customer_name")
    own = stock.join(chosen.select("platform", "outlet_code"), ["platform", "outlet_code"]).select(
        "product_code", "outlet_qty")
    return detail_rows(prods, own, names)


def detail_rows(products: DataFrame, own: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """F4 rows from one dealer's products and one outlet's stock (product_code, outlet_qty)."""
    rows = with_product_names(_with_gap(products.join(own, "product_code", "left")), names)
    return rows.select("product_code", "product_name", "offline_qty", "outlet_qty", "gap",
                       "is_ok").orderBy(F.col("is_ok").asc_nulls_last(), F.col("gap").asc_nulls_last(),
                                        F.col("product_code").asc_nulls_last())
