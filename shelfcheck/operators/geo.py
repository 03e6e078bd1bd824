"""Addresses, the geocode work queue and map points.

Geocoding itself is a per-address network call and is not done here: the queue is
written out, responses come back as a landed table, and X9 + M1 fold them in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.contracts import COARSE_GEO_LEVELS, FATAL_GEO_CODES, PLATFORM_JD, PLATFORM_MT, POINT_TYPES
from shelfcheck.functions.scalars import parse_location
from shelfcheck.operators.common import is_active_store, live_jd_outlets, live_mt_outlets

OWN_STORE, JD_OUTLET, MT_OUTLET = POINT_TYPES


def address_sources(stores: DataFrame, jd_outlets: DataFrame, mt_outlets: DataFrame) -> DataFrame:
    """Distinct trimmed non-empty addresses of active stores and live outlets,
    each with max(city) ('' for a missing city)."""
    def part(df):
        return df.where(F.col("store_address").isNotNull()).select(
            F.btrim("store_address").alias("address"), F.coalesce("city", F.lit("")).alias("city"))

    both = (part(stores.where(is_active_store("remark")))
            .unionByName(part(live_jd_outlets(jd_outlets)))
            .unionByName(part(live_mt_outlets(mt_outlets))))
    return both.where(F.col("address") != "").groupBy("address").agg(F.max("city").alias("city"))


def geocode_queue(sources: DataFrame, cache: DataFrame, retry_fail: bool = False,
                  limit: int | None = None) -> DataFrame:
    """Addresses still to geocode. Cached ``ok`` (and ``fail`` unless retrying)
    are skipped; ``limit`` caps one run, taking addresses in a stable order."""
    skip = ["ok"] if retry_fail else ["ok", "fail"]
    done = cache.where(F.col("status").isin(*skip)).select("address")
    todo = sources.join(done, "address", "left_anti")
    if limit:
        todo = todo.orderBy("address").limit(limit)
    return todo


RESPONSE_SCHEMA = (
    "status string, info string, infocode string, "
    "geocodes array<struct<location: string, adcode: string, formatted_address: string, level: string>>"
)


def classify_responses(responses: DataFrame) -> DataFrame:
    """Landed geocoder responses (address, body, received_at) -> cache rows.

    ok: coordinates from the first match; fail with a reason otherwise (API error, no
    match, bad location). ``fatal`` marks codes after which a run must stop.
    """
    body = F.from_json("body", RESPONSE_SCHEMA)
    r = responses.select("address", "received_at", body.alias("b"))
    first = F.try_element_at(F.col("b.geocodes"), F.lit(1))
    loc = parse_location(first.getField("location"))
    api_ok = F.col("b.status") == "1"
    has_match = F.coalesce(F.size(F.col("b.geocodes")) > 0, F.lit(False))
    ok = api_ok & has_match & loc.getField("ok")
    error = (F.when(~F.coalesce(api_ok, F.lit(False)), F.lit("api"))
             .when(~has_match, F.lit("no match"))
             .when(~loc.getField("ok"), F.lit("bad location")))
    nz = lambda c: F.when(c != "", c)  # noqa: E731  '' from the API means absent
    return r.select(
        "address",
        F.when(ok, loc.getField("lng")).alias("lng"),
        F.when(ok, loc.getField("lat")).alias("lat"),
        F.when(ok, nz(first.getField("adcode"))).alias("adcode"),
        F.when(ok, nz(first.getField("formatted_address"))).alias("formatted_address"),
        F.when(ok, nz(first.getField("level"))).alias("level"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("fail")).alias("status"),
        F.col("received_at").alias("updated_at"),
        F.when(~ok, error).alias("error"),
        F.coalesce(F.col("b.infocode").isin(*FATAL_GEO_CODES), F.lit(False)).alias("fatal"),
    )


def geo_quality(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(level histogram of ok rows, most first; count of coarse ok rows)."""
    ok = cache.where(F.col("status") == "ok")
    hist = ok.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), F.col("level").asc_nulls_last())
    coarse = ok.agg(F.count_if(F.col("level").isNull() | F.col("level").isin(*COARSE_GEO_LEVELS))
                    .alias("coarse"))
    return hist, coarse


def point_sku_counts(jd_stock: DataFrame | None = None, mt_stock: DataFrame | None = None,
                     unique: DataFrame | None = None) -> DataFrame:
    """Distinct products per platform store: (platform, store_code, sku_cnt).

    Stock rows are first reduced to (platform, store, product), so no DISTINCT
    aggregate runs over raw rows; ``unique`` (platform, outlet_code, product_code) is
    already one row per key and is only counted.
    """
    if unique is not None:
        return (unique.where(F.col("product_code").isNotNull())
                .groupBy("platform", F.col("outlet_code").alias("store_code"))
                .agg(F.count(F.lit(1)).alias("sku_cnt")))
    jd = jd_stock.select(F.lit(PLATFORM_JD).alias("platform"), F.col("store_code"), "product_code")
    mt = mt_stock.select(F.lit(PLATFORM_MT).alias("platform"), F.col("store_id").alias("store_code"),
                         "product_code")
    pairs = jd.unionByName(mt).where(F.col("product_code").isNotNull()).distinct()
    return pairs.groupBy("platform", "store_code").agg(F.count(F.lit(1)).alias("sku_cnt"))


def map_points(stores: DataFrame, jd_outlets: DataFrame, mt_outlets: DataFrame, cache: DataFrame,
               sku_counts: DataFrame) -> DataFrame:
    """J10 + J11 + F6: own stores + live jd / mt outlets, coordinates by trimmed address
    (unlocated points kept with null lng / lat), SKU counts per platform store; S10 order."""
    pts = located_points(stores, jd_outlets, mt_outlets, cache)
    jdc = sku_counts.where(F.col("platform") == PLATFORM_JD).select(
        F.col("store_code").alias("_jd"), F.col("sku_cnt").alias("jd_sku_cnt"))
    mtc = sku_counts.where(F.col("platform") == PLATFORM_MT).select(
        F.col("store_code").alias("_mt"), F.col("sku_cnt").alias("mt_sku_cnt"))
    pts = pts.join(jdc, "_jd", "left").join(mtc, "_mt", "left").drop("_jd", "_mt")
    return pts.select(
        "point_type", "platform", "name", "customer_name", "province", "city", "address",
        "lng", "lat", "jd_sku_cnt", "mt_sku_cnt", "adcode",
    ).orderBy(*point_order())


def point_order() -> list:
    """S10."""
    return [F.col(c).asc_nulls_last() for c in ("point_type", "platform", "customer_name", "name")]


def located_points(stores: DataFrame, jd_outlets: DataFrame, mt_outlets: DataFrame, cache: DataFrame) -> DataFrame:
    """All map points with coordinates, without their SKU counts."""
    own = stores.where(is_active_store("remark")).select(
        F.lit(OWN_STORE).alias("point_type"), F.lit(None).cast("string").alias("platform"),
        F.col("store_name").alias("name"), "customer_name", "province", "city",
        F.col("store_address").alias("address"), F.col("jd_id").alias("_jd"),
        F.col("meituan_id").alias("_mt"))
    jd = live_jd_outlets(jd_outlets).select(
        F.lit(JD_OUTLET).alias("point_type"), F.lit(PLATFORM_JD).alias("platform"),
        F.col("store_name").alias("name"), F.col("dealer").alias("customer_name"),
        F.lit(None).cast("string").alias("province"), "city", F.col("store_address").alias("address"),
        F.col("store_code").alias("_jd"), F.lit(None).cast("string").alias("_mt"))
    mt = live_mt_outlets(mt_outlets).select(
        F.lit(MT_OUTLET).alias("point_type"), F.lit(PLATFORM_MT).alias("platform"),
        F.col("store_name").alias("name"), F.col("dealer").alias("customer_name"),
        F.lit(None).cast("string").alias("province"), "city", F.col("store_address").alias("address"),
        F.lit(None).cast("string").alias("_jd"), F.col("store_id").alias("_mt"))
    pts = own.unionByName(jd).unionByName(mt)
    geo = cache.where(F.col("status") == "ok").select(
        F.col("address").alias("_addr"), "lng", "lat", "adcode")
    return pts.join(geo, F.btrim(pts["address"]) == geo["_addr"], "left").drop("_addr")


def point_type_index(point_type: str = "point_type", platform: str = "platform"):
    """own store 0, jd outlet 1, anything else 2."""
    return (F.when(F.col(point_type) == OWN_STORE, F.lit(0))
            .when(F.col(platform) == PLATFORM_JD, F.lit(1)).otherwise(F.lit(2)))


def located_count(points: DataFrame) -> DataFrame:
    """A10: total points and points with coordinates."""
    return points.agg(F.count(F.lit(1)).alias("total"), F.count("lng").alias("located"))
