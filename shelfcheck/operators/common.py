"""Small helpers shared by the operators: filters on dimensions.

Joins carry no broadcast hints: Spark broadcasts a side when its measured bytes are below the
session's threshold (from file sizes at planning, from shuffle sizes at run time) and joins by
shuffle otherwise, splitting skewed partitions. One plan serves every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck.contracts import INACTIVE_REMARKS, JD_LIVE_STORE_STATUS, MT_LIVE_BUSINESS_STATUS

def is_active_store(remark: Column | str = "remark") -> Column:
    """a store is active unless its remark marks it closed or an airport store."""
    r = F.col(remark) if isinstance(remark, str) else remark
    return ~F.coalesce(r, F.lit("")).isin(*INACTIVE_REMARKS)


def active_stores(stores: DataFrame) -> DataFrame:
    """F1 as a filter."""
    return stores.where(is_active_store("remark"))


def live_jd_outlets(outlets: DataFrame) -> DataFrame:
    """jd outlets whose store status is enabled; null status is not live."""
    return outlets.where(F.col("store_status") == JD_LIVE_STORE_STATUS)


def live_mt_outlets(outlets: DataFrame) -> DataFrame:
    """mt outlets that are open for business; null status is not live."""
    return outlets.where(F.col("business_status") == MT_LIVE_BUSINESS_STATUS)


def non_empty_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """keep rows where any key field is set."""
    return df.where(F.coalesce(*[F.col(k) for k in keys]).isNotNull())



def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """The distinct rows of ``cols``, reduced by hashing before they are shuffled. The count keeps this
    apart from an aggregate that follows, which over texts would sort all rows."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0).select(*cols)
