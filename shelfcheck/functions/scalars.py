"""Row-level column expressions (all JVM-side, no Python UDF).

Functions that take ``str`` arguments take SQL expressions (usually a column name),
because they need operators the Column API does not expose (``div``, ``try_cast``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcheck.contracts import UNKNOWN_USER

# Unicode-aware whitespace at either end (includes tab, NBSP and U+3000).
_EDGE_SPACE = r"(?U)^\s+|\s+$"
_WHOLE_DECIMAL = r"^-?[0-9]+\.0*$"
# I9 on text as one pattern, so that a cell is read once: edge whitespace around a whole decimal
# ($1 is what stays of it), any other text ($2) or nothing.
_CELL_TEXT = r"(?Us)\A\s*(?:(-?[0-9]+)\.0*|(\S(?:.*\S)?)|)\s*\z"
_INTEGER_TEXT = r"^-?[0-9]+$"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_all(c: Column | str) -> Column:
    """X3 ``strip``: remove every kind of Unicode whitespace at both ends."""
    return F.regexp_replace(col_of(c), _EDGE_SPACE, "")


def trim_spaces(c: Column | str) -> Column:
    """X3 ``btrim``: remove ASCII spaces only (SQL semantics)."""
    return F.btrim(col_of(c))


def blank_to_null(c: Column | str) -> Column:
    """'' -> null after a full strip."""
    s = strip_all(c)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def to_int(sql: str) -> Column:
    """Text or number -> bigint, truncating toward zero; '' / NaN / junk -> null."""
    return F.expr(_exact_int(f"try_cast({sql} AS STRING)"))


def _exact_int(text: str) -> str:
    """Integers keep every digit; only other numbers go through DOUBLE and are truncated."""
    return f"coalesce(try_cast({text} AS BIGINT), try_cast(try_cast({text} AS DOUBLE) AS BIGINT))"


def to_double(sql: str) -> Column:
    return F.expr(f"try_cast(try_cast({sql} AS STRING) AS DOUBLE)")


def whole_number_text(c: Column | str) -> Column:
    """'12345.0' -> '12345'; other text unchanged (I9 / X2 text rule)."""
    c = col_of(c)
    return F.when(c.rlike(_WHOLE_DECIMAL), F.regexp_replace(c, r"\.0*$", "")).otherwise(c)


def coerce_cell(c: str, declared: str) -> Column:
    """Cell -> declared type ``text`` / ``int`` / ``float``; invalid -> null."""
    if declared == "text":
        return whole_number_text(blank_to_null(F.col(c)))
    if declared == "int":
        return F.expr(f"try_cast({_exact_int(f'try_cast({c} AS STRING)')} AS INT)")
    if declared == "float":
        return to_double(c)
    raise ValueError(f"unknown declared type {declared!r}")


def format_value(c: str, target: str) -> Column:
    """Render a source cell into the inferred type; '' -> null; uncastable -> null."""
    if target == "bigint":  # the cast trims ASCII whitespace itself
        return F.expr(f"coalesce(try_cast(CAST(`{c}` AS STRING) AS BIGINT), {_exact_int(f"nullif({_strip_sql(c)}, '')")})")
    if target == "double":
        return F.expr(f"try_cast(nullif({_strip_sql(c)}, '') AS DOUBLE)")
    if target == "timestamp":
        return F.expr(f"try_cast(nullif({_strip_sql(c)}, '') AS TIMESTAMP)")
    return F.nullif(F.regexp_replace(F.col(c).cast("string"), _CELL_TEXT, "$1$2"), F.lit(""))


def _strip_sql(c: str) -> str:
    return f"regexp_replace(CAST(`{c}` AS STRING), '(?U)^\\\\s+|\\\\s+$', '')"


def is_integer_text(c: Column | str) -> Column:
    """Text holding an integer."""
    return col_of(c).rlike(_INTEGER_TEXT)


def minute_text(c: Column | str) -> Column:
    """Time -> 'YYYY-MM-DD HH:MM'."""
    return F.date_format(col_of(c), "yyyy-MM-dd HH:mm")


def adcode_prefix(c: Column | str, level: str) -> Column:
    """Region prefix of an adcode, 2 chars for province, 4 for city."""
    n = {"province": 2, "city": 4}[level]
    return F.substring(col_of(c), 1, n)


def parse_location(c: Column | str) -> Column:
    """X8: 'lng,lat' -> struct(lng, lat, ok); wrong form -> ok false, lng/lat null."""
    parts = F.split(col_of(c), ",")
    lng = F.when(F.size(parts) == 2, parts.getItem(0).try_cast("double"))
    lat = F.when(F.size(parts) == 2, parts.getItem(1).try_cast("double"))
    ok = F.coalesce(lng.isNotNull() & lat.isNotNull(), F.lit(False))
    return F.struct(
        F.when(ok, lng).alias("lng"), F.when(ok, lat).alias("lat"), ok.alias("ok")
    )


def display_name(name: Column | str, ident: Column | str) -> Column:
    """Name, else the first 8 chars of the id, else the unknown label."""
    nm = col_of(name)
    idc = col_of(ident)
    return F.coalesce(
        F.when(nm != "", nm),
        F.when(F.substring(idc, 1, 8) != "", F.substring(idc, 1, 8)),
        F.lit(UNKNOWN_USER),
    )
