"""Load source exports under a checked column contract.

Exports are read with every column as text (leading zeros and long barcodes survive),
headers are normalised and mapped to canonical names, the contract is validated for
*all* selected datasets before anything is written, types are inferred in one
aggregate pass, and each dataset is written as a new version that is published only
when every dataset of the run succeeded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate, chain, count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfcheck.contracts import (
    ADDRESS_HEADERS,
    ADDRESS_STEM,
    DATASET_TABLES,
    DESCRIPTION_ROW_MARKERS,
    EDITED_TABLES,
    HEADER_MAPS,
    ID_NAME_PATTERN,
    OPTIONAL_HEADERS,
    SOURCE_STEMS,
    STATUS_HEADER_ANCHORS,
    STATUS_HEADER_PREFIX,
)
from shelfcheck.functions.scalars import coerce_cell, format_value, strip_all
from shelfcheck.sources.headers import HeaderGroup, header_groups

_ID_RE = re.compile(ID_NAME_PATTERN, re.I)
_INT_TEXT = r"^-?[0-9]+$"
_NO_EDGE_SPACE = r"(?Us)\A\S(?:.*\S)?\z"
# What every text has that casts to a double; a failed cast costs an exception per row.
_NUMBER_TEXT = r"(?i)\A[\x00-\x20]*[+-]?(?:[0-9.][0-9a-fxp.+-]*|inf|infinity|nan)[\x00-\x20]*\z"
SOURCE_COLUMNS = ("source_file", "source_pos")  # added by with_source_order


class ContractError(ValueError):
    """A dataset breaks its contract; nothing has been written."""


# ---------------------------------------------------------------- I1 reading

@dataclass
class Export:
    """An export as read, and the groups its files' headers form (one where all agree)."""

    frame: DataFrame
    groups: list[HeaderGroup]


def open_export(spark: SparkSession, path, fmt: str = "csv", multi_line: bool = False, context_headers: bool = False,
                ordered: bool = False, **options) -> Export:
    """Read an export with every column as text (CSV, xlsx) or as stored (parquet / json).

    Columns get the names the files' own first records state, blanks and repeats included
    (``normalize_frame`` makes them usable). Files whose headers differ, in order or in names,
    are united by normalised name. ``ordered`` adds ``SOURCE_COLUMNS``. ``multi_line`` allows
    quoted line breaks, at the price of one task per file.
    """
    if fmt == "xlsx":
        from shelfcheck.sources.xlsx import read_workbook

        read = read_workbook(spark, path, **options)
        groups = [HeaderGroup(names, files, len(files)) for names, files, _ in read]
        frames = [df if ordered else df.drop(*SOURCE_COLUMNS) for _, _, df in read]
        return _united(spark, groups, frames, context_headers)
    if fmt != "csv":
        frame = spark.read.format(fmt).options(**options).load(path)
        return Export(with_source_order(frame) if ordered else frame, [])
    reader = spark.read.options(inferSchema=False, multiLine=multi_line, **options)
    groups = header_groups(spark, path, multi_line, **options)
    if not groups:
        return Export(reader.csv(path, header=False), [])
    frames = []
    for g in groups:
        # With a schema of its own the reader drops each file's header record unseen.
        schema = ", ".join(f"_c{i} string" for i in range(len(g.names)))
        frame = reader.schema(schema).csv(g.files or path, header=True, enforceSchema=True)
        if multi_line:  # in this mode the reader leaves the first half of a CRLF in the last column
            last = f"_c{len(g.names) - 1}"
            cut = F.regexp_replace(last, "\r$", "")
            frame = frame.withColumn(last, F.when(cut != "", cut))
        frame = frame.toDF(*g.names)
        frames.append(with_source_order(frame) if ordered else frame)
    return _united(spark, groups, frames, context_headers)


def _united(spark: SparkSession, groups: list[HeaderGroup], frames: list[DataFrame], context_headers: bool) -> Export:
    if not frames:
        return Export(spark.createDataFrame([], "_blank string"), groups)
    if len(frames) > 1:
        frames = [normalize_frame(f, context_headers) for f in frames]
    return Export(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames), groups)


def read_export(spark: SparkSession, path, fmt: str = "csv", multi_line: bool = False, **options) -> DataFrame:
    """The frame of ``open_export``."""
    return open_export(spark, path, fmt, multi_line, **options).frame


def header_findings(groups: list[HeaderGroup], dataset: str, context_headers: bool = False) -> list[Finding]:
    """I7 for exports whose files differ: columns that some files lack (an error if required) or
    alone have."""
    if len(groups) < 2:
        return []
    named = [normalize_headers(prefix_context_headers(g.names) if context_headers else g.names) for g in groups]
    required = [c for c in HEADER_MAPS.get(dataset, {}) if c not in OPTIONAL_HEADERS]
    every = list(dict.fromkeys(c for names in named for c in names if not c.startswith("_blank")))
    out = []
    for c in every:
        lacking = sum(g.count for g, names in zip(groups, named) if c not in names)
        if lacking:
            out.append(Finding(dataset, f"missing_in_{lacking}_files", c, "error" if c in required else "warning"))
    return out


def prefer_source(spark: SparkSession, candidates: list[str], fmt: str = "csv",
                  **options) -> tuple[str, DataFrame]:
    """The first candidate path that *exists* wins (an empty file still wins)."""
    path, export = prefer_export(spark, candidates, fmt, **options)
    return path, export.frame


def prefer_export(spark: SparkSession, candidates: list[str], fmt: str = "csv", **options) -> tuple[str, Export]:
    for path in candidates:
        try:
            return path, open_export(spark, path, fmt, **options)
        except FileNotFoundError:
            continue
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                continue
            raise
    raise FileNotFoundError(candidates)


def with_source_order(df: DataFrame) -> DataFrame:
    """Number rows in source order per file: ``source_file`` and ``source_pos``.

    ``source_pos`` = (split start offset, position inside the split); it orders rows of
    one file as they appear in it, however splits are spread over partitions.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("source_pos"),
    )


# ---------------------------------------------------------------- I2 / I3 / I5 headers

def normalize_headers(names: list[str]) -> list[str]:
    """Strip; blank / 'Unnamed:*' / 'nan' -> '_blank'; repeats -> name_2, name_3...

    Generated names never collide with a later or earlier header (``a, a_2, a`` gives
    ``a, a_2, a_3``), so the result is always unique.
    """
    out: list[str] = []
    taken: set[str] = set()
    for name in names:
        stem = "" if name is None else str(name).strip()
        if stem in ("", "nan") or stem.startswith("Unnamed:"):
            stem = "_blank"
        choices = chain([stem], (f"{stem}_{k}" for k in count(2)))
        taken_now = next(c for c in choices if c not in taken)
        taken.add(taken_now)
        out.append(taken_now)
    return out


def prefix_context_headers(names: list[str]) -> list[str]:
    """A header starting with the status prefix takes the platform of the last
    anchor column to its left; before any anchor it stays unchanged."""
    stripped = [str(c).strip() for c in names]
    last_anchor = accumulate((STATUS_HEADER_ANCHORS.get(c) for c in stripped), lambda held, new: new or held)
    return [f"{platform}{STATUS_HEADER_PREFIX}" if platform and c.startswith(STATUS_HEADER_PREFIX) else c
            for c, platform in zip(stripped, last_anchor)]


def apply_contract_names(df: DataFrame, dataset: str) -> DataFrame:
    """Source header -> canonical name; unknown headers are kept as they are."""
    mapping = {k: v for k, v in HEADER_MAPS.get(dataset, {}).items() if k in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df


def normalize_frame(df: DataFrame, context_headers: bool = False) -> DataFrame:
    names = list(df.columns)
    if context_headers:
        names = prefix_context_headers(names)
    return df.toDF(*normalize_headers(names))


# ---------------------------------------------------------------- I4 / I6 rows and columns

def skip_description_row(df: DataFrame) -> DataFrame:
    """I4: drop the first data row of each file when its first cell is a field
    description (contains a marker). Needs ``with_source_order`` columns.

    The first row per file is found with an aggregate (``min``), not a window, so a
    large file is never gathered into one task.
    """
    first_col = [c for c in df.columns if c not in SOURCE_COLUMNS][0]
    at = df.schema["source_pos"].dataType
    firsts = df
    if isinstance(at, StructType):  # the last part alone first: a minimum of numbers needs no sorting of the rows
        *parts, last = at.names
        firsts = (df.groupBy("source_file", *[F.col("source_pos")[c].alias(f"_{c}") for c in parts])
                  .agg(F.min(F.col("source_pos")[last]).alias(f"_{last}"))
                  .select("source_file", F.struct(*[F.col(f"_{c}").alias(c) for c in at.names]).alias("source_pos")))
    firsts = firsts.groupBy("source_file").agg(F.min("source_pos").alias("_first"))
    cell = F.coalesce(F.col(first_col).cast("string"), F.lit(""))
    is_desc = F.lit(False)
    for m in DESCRIPTION_ROW_MARKERS:
        is_desc = is_desc | cell.contains(m)
    joined = df.join(F.broadcast(firsts), "source_file", "left")  # one row per file
    return joined.where(~((F.col("source_pos") == F.col("_first")) & is_desc)).drop("_first")


def drop_empty_blank_columns(df: DataFrame, stats: dict | None = None) -> DataFrame:
    """Drop ``_blank*`` columns that are null in every row (one aggregate pass)."""
    blanks = [c for c in df.columns if c.startswith("_blank")]
    if not blanks:
        return df
    stats = column_stats(df.select(*blanks)) if stats is None else stats
    return df.drop(*[c for c in blanks if stats[c].present == 0])


# ---------------------------------------------------------------- I7 contract check

@dataclass
class Finding:
    dataset: str
    check: str
    column: str | None
    severity: str  # error | warning


def header_difference(expected, present) -> tuple[list[str], list[str]]:
    """(missing, unknown) headers, each in the order of its own list."""
    want, have = dict.fromkeys(expected), dict.fromkeys(present)
    return [c for c in want if c not in have], [c for c in have if c not in want]


def validate_contract(df: DataFrame, dataset: str) -> list[Finding]:
    """I7 for one dataset (on normalised, *source* headers, before renaming)."""
    named = [c for c in df.columns if c not in SOURCE_COLUMNS and not c.startswith("_blank")]
    missing, unknown = header_difference(
        [c for c in HEADER_MAPS.get(dataset, {}) if c not in OPTIONAL_HEADERS], named)
    findings = [Finding(dataset, "missing_column", c, "error") for c in missing]
    if df.isEmpty():
        findings.append(Finding(dataset, "no_rows", None, "error"))
    return findings + [Finding(dataset, "unknown_column", c, "warning") for c in unknown]


def validate_all(spark: SparkSession, frames: dict[str, DataFrame], found: Sequence[Finding] = ()) -> DataFrame:
    """I7 for all selected datasets; raises ContractError if any has an error.

    ``found``: what reading them found already. Returns the findings as a DataFrame (dataset,
    check, column, severity).
    """
    findings: list[Finding] = list(found)
    for name, df in frames.items():
        findings += validate_contract(df, name)
    report = spark.createDataFrame(
        [(f.dataset, f.check, f.column, f.severity) for f in findings],
        "dataset string, check string, column string, severity string")
    errors = [f for f in findings if f.severity == "error"]
    if errors:
        raise ContractError("; ".join(f"{f.dataset}: {f.check} {f.column or ''}".strip() for f in errors))
    return report


# ---------------------------------------------------------------- I8 / I9 / I10 types

@dataclass
class ColumnStats:
    """Counts over one column's non-blank text values."""

    values: int         # not blank
    present: int        # not null
    numeric: int
    whole: int
    largest: float | None
    coded: int          # integer texts with a leading zero
    integer_text: int   # of the non-null values
    dated: int          # timestamps that state a date


def stat_values(column: str) -> list:
    """The aggregates behind ``ColumnStats``, in its order."""
    raw = F.col(column).cast("string")
    txt = F.when(raw.rlike(_NO_EDGE_SPACE), raw).otherwise(strip_all(raw))
    txt = F.when(txt != "", txt)
    num = F.when(txt.rlike(_NUMBER_TEXT), txt.try_cast("double"))
    return [F.count(txt), F.count(raw), F.count(num), F.count_if(num == F.rint(num)), F.max(F.abs(num)),
            F.count_if(txt.rlike(r"^-?0[0-9]+$")), F.count_if(raw.rlike(_INT_TEXT)),
            F.count_if(txt.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}") & txt.try_cast("timestamp").isNotNull())]


def column_stats(df: DataFrame) -> dict[str, ColumnStats]:
    """What I6, I8 and I10 need to know of every column, in one aggregate pass over the cells that
    are not null: a few aggregates per cell run compiled, those of all columns side by side do not."""
    cols = [c for c in df.columns if c not in SOURCE_COLUMNS]
    if not cols:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").cast("string").alias("cell")) for i, c in enumerate(cols)])
    found = (df.select(F.inline(cells)).where(F.col("cell").isNotNull())
             .groupBy("at").agg(F.struct(*stat_values("cell")).alias("stats")).collect())
    stats = {r["at"]: r["stats"] for r in found}
    return {c: ColumnStats(*stats.get(i, (0, 0, 0, 0, None, 0, 0, 0))) for i, c in enumerate(cols)}


def infer_types(df: DataFrame | None, stats: dict[str, ColumnStats] | None = None) -> dict[str, str]:
    """I8: canonical column name -> bigint / double / timestamp / string.

    id-like names stay text. Otherwise: all non-blank values numeric -> bigint when all
    are whole and |v| < 9e18 (and at least one is present), else double (an all-blank
    column is double); all timestamps with a date -> timestamp; anything else, and any
    column holding an integer text with a leading zero -> string.
    """
    stats = column_stats(df) if stats is None else stats
    out = {}
    for c, s in stats.items():
        if _ID_RE.search(c) or s.coded:
            out[c] = "string"
        elif s.values == 0:
            out[c] = "double"
        elif s.numeric == s.values:
            exact = s.whole == s.values and s.largest is not None and s.largest < 9e18
            out[c] = "bigint" if exact else "double"
        else:
            out[c] = "timestamp" if s.dated == s.values else "string"
    return out


def format_values(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast every column to its inferred type; '' and uncastable -> null."""
    return df.select(*[format_value(c, types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def promote_if_all_integer(df: DataFrame, col: str) -> tuple[DataFrame, bool]:
    """Text -> bigint only when every non-null value is an integer text."""
    if dict(df.dtypes).get(col) != "string":
        return df, False
    own = column_stats(df.select(col))[col]
    if own.integer_text < own.present:
        return df, False
    return df.withColumn(col, F.expr(f"try_cast(nullif(`{col}`, '') AS BIGINT)")), True


# ---------------------------------------------------------------- I11 / I12 / I13 / M6 publish

def load_dataset(df: DataFrame, dataset: str) -> DataFrame:
    """One validated export -> its table: blank columns, contract names, inferred types
    (I6, I3, I8, I9, I10), all from one pass over its values."""
    df = df.drop(*SOURCE_COLUMNS)
    stats = column_stats(df)
    out = apply_contract_names(drop_empty_blank_columns(df, stats), dataset)
    renamed = dict(HEADER_MAPS.get(dataset, {}))
    types = infer_types(out, {renamed.get(c, c): s for c, s in stats.items() if renamed.get(c, c) in out.columns})
    if dataset == "meituan_store_inventory" and types.get("stock_qty") == "string":
        own = next((s for c, s in stats.items() if renamed.get(c, c) == "stock_qty"), None)
        if own and own.integer_text == own.present:
            types["stock_qty"] = "bigint"
    return format_values(out, types)


# ---------------------------------------------------------------- per-dataset readers

def read_dataset(spark: SparkSession, folder: str, table: str, fmt: str = "csv",
                 found: list[Finding] | None = None) -> DataFrame:
    """One dataset's export as it is landed in ``folder``, ready for the contract check:
    first existing candidate file (I1), headers (I2, I5), description row (I4), store
    addresses looked up by name (J3). ``found`` receives what the files' headers show."""
    files = [os.path.join(folder, f"{stem}.{fmt}") for stem in SOURCE_STEMS[table]]
    context, described = table == "feishu_store_mapping", table == "meituan_store_inventory"
    _, export = prefer_export(spark, files, fmt, context_headers=context, ordered=described)
    if found is not None:
        found += header_findings(export.groups, table, context)
    df = normalize_frame(export.frame, context_headers=context)
    if described:
        df = skip_description_row(df).drop(*SOURCE_COLUMNS)
    if context:
        df = fill_addresses(spark, df, folder, fmt)
    return df


def fill_addresses(spark: SparkSession, stores: DataFrame, folder: str, fmt: str = "csv") -> DataFrame:
    """J3 on the mapping export: its address column from the store detail export, by store
    name; all null without that file or its two columns."""
    from shelfcheck.operators.match import address_book, lookup_address

    name, address = ADDRESS_HEADERS
    ordered = spark.createDataFrame([], f"`{name}` string, `{address}` string, line_no long")
    try:
        _, export = prefer_export(spark, [os.path.join(folder, f"{ADDRESS_STEM}.{fmt}")], fmt, ordered=True)
        found = normalize_frame(export.frame)
        if {name, address} <= set(found.columns):
            ordered = found.select(name, address, F.struct(*SOURCE_COLUMNS).alias("line_no"))  # file order
    except FileNotFoundError:
        pass
    book = address_book(ordered, name, address)
    target = next(h for h, c in HEADER_MAPS["feishu_store_mapping"].items() if c == "store_address")
    shop = next(h for h, c in HEADER_MAPS["feishu_store_mapping"].items() if c == "store_name")
    return lookup_address(stores.drop(target), book, shop).withColumnRenamed("store_address", target)


def load_folder(spark: SparkSession, root: str, folder: str, version: str, keys: list[str] | None = None,
                fmt: str = "csv") -> Publication:
    """I12 from files: every selected dataset read by its own rules, then ``load``."""
    found: list[Finding] = []
    sources = {t: read_dataset(spark, folder, t, fmt, found) for t in select_datasets(keys)}
    return load(spark, root, sources, version, keys, found)


def select_datasets(keys: list[str] | None) -> list[str]:
    """Dataset keys -> tables; unknown key -> error; none = all; each table once."""
    unknown = sorted(set(keys or []) - DATASET_TABLES.keys())
    if unknown:
        raise ValueError(f"unknown dataset {unknown}, expected some of {list(DATASET_TABLES)}")
    return list(dict.fromkeys(t for k in keys or DATASET_TABLES for t in DATASET_TABLES[k]))


def stamp_snapshot(spark: SparkSession) -> DataFrame:
    """The one-row load-time table."""
    return spark.range(1).select(F.current_timestamp().alias("loaded_at"))


def snapshot_time(spark: SparkSession, meta: DataFrame | None = None) -> DataFrame:
    """I13 reader side: max(loaded_at), or now when there is none."""
    if meta is None:
        return stamp_snapshot(spark)
    return meta.agg(F.coalesce(F.max("loaded_at"), F.current_timestamp()).alias("loaded_at"))


@dataclass
class Publication:
    version: str
    tables: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)


def publish(spark: SparkSession, root: str, frames: dict[str, DataFrame], version: str) -> Publication:
    """I11 + M6: write every table as ``root/<table>/v=<version>``; only when all writes
    succeeded, append one row per table to ``root/_published`` (the pointer log).

    Readers take each table's latest published version (``current_path``), so a failed
    run leaves the former version current, and a partial run is never visible.
    """
    pub = Publication(version)
    for table, df in frames.items():
        path = os.path.join(root, table, f"v={version}")
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        pub.tables[table] = path
        pub.rows[table] = seen.get["n"]
    log = spark.createDataFrame(
        [(t, version, p, pub.rows[t]) for t, p in pub.tables.items()],
        "table string, version string, path string, rows bigint",
    ).withColumn("published_at", F.current_timestamp())
    log.write.mode("append").parquet(os.path.join(root, "_published"))
    return pub


def published_rows(spark: SparkSession, root: str, table: str, version: str) -> int | None:
    """Rows of a version that is already published, or None."""
    try:
        log = spark.read.parquet(os.path.join(root, "_published"))
    except AnalysisException:
        return None
    row = log.where((F.col("table") == table) & (F.col("version") == version)).head()
    return row["rows"] if row else None


def current_path(spark: SparkSession, root: str, table: str) -> str | None:
    """Latest published version of ``table`` (M6 reader side)."""
    try:
        log = spark.read.parquet(os.path.join(root, "_published"))
    except AnalysisException:
        return None
    row = (log.where(F.col("table") == table)
           .agg(F.max_by("path", F.struct("published_at", "version")).alias("p")).first())
    return row["p"] if row else None


def load(spark: SparkSession, root: str, sources: dict[str, DataFrame], version: str,
         keys: list[str] | None = None, found: Sequence[Finding] = ()) -> Publication:
    """I12 end to end: select, validate all (I7), then load and publish together."""
    tables = select_datasets(keys)
    missing = [t for t in tables if t not in sources]
    if missing:
        raise FileNotFoundError(missing)
    chosen = {t: sources[t] for t in tables}
    validate_all(spark, chosen, found)
    return publish(spark, root, load_tables(spark, chosen), version)


def load_tables(spark: SparkSession, chosen: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Validated exports -> the tables to publish, with the one-row snapshot time."""
    loaded = {t: load_dataset(df, t) for t, df in chosen.items()}
    loaded["data_meta"] = stamp_snapshot(spark)
    return loaded


# ---------------------------------------------------------------- I18 edited-table import

def import_table(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Map known headers (source -> canonical), ignore unknown ones, coerce cells
    by declared type (X2), skip rows whose key fields are all empty.

    Returns (rows, counts) where counts has ``inserted`` and ``skipped_empty``; raises
    when the required column is absent. ``replace_table`` rejects an import of no rows.
    """
    cfg = EDITED_TABLES[key]
    src = {zh: (en, typ) for en, zh, typ in cfg["columns"]}
    present = {c.strip(): c for c in df.columns}
    if not any(zh in present and src[zh][0] == cfg["required"] for zh in src):
        raise ContractError(f"required column {cfg['required']} is missing")
    cols = []
    for en, zh, typ in cfg["columns"]:
        if zh in present:
            cols.append(coerce_cell(f"`{present[zh]}`", typ).alias(en))
        else:
            cols.append(F.lit(None).cast({"text": "string", "int": "int", "float": "double"}[typ]).alias(en))
    typed = df.select(*cols)
    keyed = F.coalesce(*[F.col(k).cast("string") for k in cfg["key_fields"]]).isNotNull()
    counts = typed.agg(F.count_if(keyed).alias("inserted"), F.count_if(~keyed).alias("skipped_empty"))
    return typed.where(keyed), counts


def publish_edit(spark: SparkSession, root: str, table: str, df: DataFrame, version: str) -> Publication:
    """I13 on edits: an edited or imported table and the load time, published together."""
    return publish(spark, root, {table: df, "data_meta": stamp_snapshot(spark)}, version)


def replace_table(spark: SparkSession, root: str, df: DataFrame, key: str, version: str) -> Publication:
    """I18 end to end: import, reject an import without rows, publish the replacement."""
    rows, counts = import_table(df, key)
    if counts.first()["inserted"] == 0:
        raise ContractError("no rows to import")
    return publish_edit(spark, root, EDITED_TABLES[key].get("table", key), rows, version)
