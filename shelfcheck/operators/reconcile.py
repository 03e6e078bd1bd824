"""Three-way reconciliation of book stock against two platforms.

One row per (store, product) present in any of the three sources. The sides are
stacked into one wide frame (``unionByName``) and summed by one ``groupBy``: a single
shuffle with map-side partial aggregation, so a hot store or product is reduced to one
row per map task before it crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcheck.contracts import (
    FLAG_DIFF,
    FLAG_NEG_BOOK,
    FLAG_ONLY_PLATFORM,
    FLAG_SAME,
    FLAG_UNLISTED,
    FLAG_VIRTUAL,
    FLAGS,
)
from shelfcheck.functions.rates import platform_diff

SIDES = ("book", "jd", "mt")
QTY = {"book": "bojun_qty", "jd": "jd_qty", "mt": "mt_qty"}
NAME = {"book": "book_name", "jd": "jd_name", "mt": "mt_name"}


def stack_sides(
    sides: dict[str, DataFrame],
    keys: tuple[str, ...] = ("store_key", "product_key"),
    qty: str = "qty",
    name: str | None = None,
) -> DataFrame:
    """Bring separate side frames (keys + qty [+ name]) into the wide line form.

    Every side becomes ``keys, bojun_qty, jd_qty, mt_qty, book_name, jd_name, mt_name``
    with nulls for the other sides; ``unionByName`` stacks them without a shuffle.
    """
    out = None
    for side, df in sides.items():
        if side not in SIDES:
            raise ValueError(f"unknown side {side!r}, expected one of {SIDES}")
        cols = [F.col(k) for k in keys]
        for s in SIDES:
            q = F.col(qty).cast("bigint") if s == side else F.lit(None).cast("bigint")
            cols.append(q.alias(QTY[s]))
        for s in SIDES:
            n = F.col(name).cast("string") if (s == side and name) else F.lit(None).cast("string")
            cols.append(n.alias(NAME[s]))
        part = df.select(*cols)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sides given")
    return out


def flag_expr(book: Column, jd: Column, mt: Column, jd_diff: Column, mt_diff: Column,
              virtual_threshold: int) -> Column:
    """Exactly one flag per row, by precedence (see SURVEY 2.11)."""
    return (
        F.when(book < 0, F.lit(FLAG_NEG_BOOK))
        .when(book.isNull(), F.lit(FLAG_ONLY_PLATFORM))
        .when(jd.isNull() & mt.isNull(), F.lit(FLAG_UNLISTED))
        .when((jd >= virtual_threshold) | (mt >= virtual_threshold), F.lit(FLAG_VIRTUAL))
        .when((jd_diff != 0) | (mt_diff != 0), F.lit(FLAG_DIFF))
        .otherwise(F.lit(FLAG_SAME))
    )


def reconcile(
    lines: DataFrame,
    virtual_threshold: int,
    keys: tuple[str, ...] = ("store_key", "product_key"),
) -> DataFrame:
    """J1 on the wide line form: per key, summed quantities, diffs and the flag.

    Names present in ``lines`` (book_name / jd_name / mt_name) are reduced with
    ``max`` and merged by J12 (book name first, then jd, then mt).
    """
    aggs = [F.sum(F.col(QTY[s]).cast("bigint")).alias(QTY[s]) for s in SIDES]
    has_names = all(NAME[s] in lines.columns for s in SIDES)
    if has_names:
        aggs += [F.max(NAME[s]).alias(NAME[s]) for s in SIDES]
    detail = lines.groupBy(*keys).agg(*aggs)
    if has_names:
        detail = detail.withColumn("product_name", fallback_product_name()).drop(
            *[NAME[s] for s in SIDES])
    book, jd, mt = F.col("bojun_qty"), F.col("jd_qty"), F.col("mt_qty")
    jd_diff, mt_diff = platform_diff(jd, book), platform_diff(mt, book)
    return detail.select(
        "*", jd_diff.alias("jd_diff"), mt_diff.alias("mt_diff"),
        flag_expr(book, jd, mt, jd_diff, mt_diff, virtual_threshold).alias("flag"),
    )


def fallback_product_name() -> Column:
    """The book system may not carry a name; fall back to the platforms' names."""
    return F.coalesce(*[F.col(NAME[s]) for s in SIDES])


def flag_index(flag: Column | str = "flag") -> Column:
    """flag -> 0..5 by list position; an unknown flag raises at runtime."""
    c = F.col(flag) if isinstance(flag, str) else flag
    pos = F.array_position(F.array(*[F.lit(f) for f in FLAGS]), c)
    return F.when(pos > 0, (pos - 1).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unknown flag: "), F.coalesce(c, F.lit("null"))))
    )


def attach_dims(detail: DataFrame, stores: DataFrame, products: DataFrame | None = None,
                more: tuple[str, ...] = ()) -> DataFrame:
    """Name the keys: store_key -> customer_name, store_name (and ``more`` of the stores' columns);
    product_key -> code and name.

    ``stores`` must be unique per store_key and ``products`` unique per product_key,
    so neither join can multiply rows.
    """
    out = detail.join(stores.select("store_key", "customer_name", "store_name", *more), "store_key", "left")
    if products is not None:
        pn = products.select("product_key", F.col("product_name").alias("_catalog_name"))
        out = out.join(pn, "product_key", "left")
        if "product_name" in detail.columns:
            out = out.withColumn("product_name", F.coalesce("product_name", "_catalog_name"))
        else:
            out = out.withColumnRenamed("_catalog_name", "product_name")
        out = out.drop("_catalog_name")
    return out.withColumn("product_code", F.col("product_key").cast("string"))


DETAIL_COLUMNS = [
    "customer_name", "store_name", "product_code", "product_name",
    "bojun_qty", "jd_qty", "mt_qty", "jd_diff", "mt_diff", "flag",
]
