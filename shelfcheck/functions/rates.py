"""Maintenance-rate and diff expressions (A3, A4, A5) in exact integer arithmetic.

Rates are percentages rounded half away from zero to one decimal. They are computed
as whole tenths with integer ``div`` and turned into a double at the end, so every
engine that follows the same rule produces bit-identical values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_tenths_sql(num: str, den: str) -> str:
    """SQL for round(100 * num / den, 1), half away from zero; null when den is null or 0.

    ``num`` and ``den`` are integral SQL expressions; ``den`` is positive where used.
    """
    return (
        f"CASE WHEN ({den}) IS NULL OR ({den}) = 0 OR ({num}) IS NULL THEN CAST(NULL AS DOUBLE) "
        f"WHEN ({num}) >= 0 THEN CAST((2000 * ({num}) + ({den})) div (2 * ({den})) AS DOUBLE) / 10 "
        f"ELSE -(CAST((2000 * -({num}) + ({den})) div (2 * ({den})) AS DOUBLE) / 10) END"
    )


def pct_tenths(num: str, den: str) -> Column:
    return F.expr(pct_tenths_sql(num, den))


def group_rate(cmp_sum: str, base_sum: str) -> Column:
    """A4: least(100, round(100 * cmp_sum / nullif(base_sum, 0), 1)).

    ``least`` skips nulls, so a group without comparable rows gets 100, not null.
    """
    return F.least(F.lit(100.0), pct_tenths(cmp_sum, base_sum))


def row_rate(platform: str, book: str) -> Column:
    """A5: per-row rate; null when either side is null or there is no positive base."""
    p, b = F.col(platform), F.col(book)
    return (
        F.when(p.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(p >= b, F.lit(100.0))
        .when(b > 0, pct_tenths(platform, book))
        .otherwise(F.lit(None).cast("double"))
    )


def platform_diff(platform: Column, book: Column) -> Column:
    """diff = platform - coalesce(book, 0) where the platform lists the product, else null."""
    return F.when(platform.isNotNull(), platform - F.coalesce(book, F.lit(0)))
