"""Edited-table export and the load history.

The load history is an append-only dataset: every run appends one row (a single
small file per append), readers sort and cut it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.contracts import (
    EDITED_TABLES,
    LOAD_LOG_MESSAGE_LIMIT,
    LOAD_LOG_ROWS_PATTERN,
    LOAD_LOG_SKIP_WORD,
)
from shelfcheck.functions.scalars import minute_text
from shelfcheck.operators.changes import sort_for_listing
from shelfcheck.operators.common import non_empty_rows
from shelfcheck.sources.files import Files


def export_table(df: DataFrame, key: str) -> DataFrame:
    """K5: every declared column in declared order, non-empty rows only (F3), S7 order.

    Headers are the source headers, so the export can be imported again (I18).
    """
    cfg = EDITED_TABLES[key]
    rows = non_empty_rows(df, [k for k in cfg["key_fields"] if k in df.columns])
    if "id" in rows.columns:
        rows = sort_for_listing(rows, cfg["required"])
    types = {"text": "string", "int": "int", "float": "double"}
    return rows.select(*[
        (F.col(en) if en in rows.columns else F.lit(None).cast(types[t])).alias(zh)
        for en, zh, t in cfg["columns"]])


def load_log_row(spark: SparkSession, label: str, filename: str | None, size: int | None,
                 state: str, message: str | None, operator: str | None,
                 limit: int = LOAD_LOG_MESSAGE_LIMIT) -> DataFrame:
    """K6: one history row; ``message`` is cut to ``limit`` for listings, ``full_message``
    keeps it whole; '' becomes null."""
    row = spark.createDataFrame([(label, filename, size, state, message or "", operator or "")],
                                "label string, filename string, size_bytes bigint, state string, "
                                "message string, operator string")
    return log_rows(row.withColumn("created_at", F.current_timestamp()), limit)


def log_rows(runs: DataFrame, limit: int = LOAD_LOG_MESSAGE_LIMIT) -> DataFrame:
    """K6 over many runs: (created_at, label, filename, size_bytes, state, message, operator), and
    an ``id`` if they have one."""
    own = ["id"] if "id" in runs.columns else []
    return runs.select(
        *own, "created_at", "label", "filename", "size_bytes", "state",
        F.substring("message", 1, limit).alias("message"), F.col("message").alias("full_message"),
        F.when(F.col("operator") != "", F.col("operator")).alias("operator"),
    )


def append_load_log(row: DataFrame, root: str) -> None:
    """K6: append to the history dataset."""
    row.coalesce(1).write.mode("append").parquet(os.path.join(root, "upload_log"))


def log_once(row: DataFrame, root: str, run: str) -> None:
    """K6 for runs that may be replayed: the row of a run whose mark is there is not added again."""
    files, mark = Files(row.sparkSession), os.path.join(root, "_logged", run)
    if not files.exists(mark):
        append_load_log(row, root)
        files.put(mark, {})


def load_log_message(lines: DataFrame) -> DataFrame:
    """K7 over run outputs: (run_id, ok, lines array<string>) -> (run_id, message).

    Success: the row count of the first line reporting one; failure: the last
    non-blank line that is not a warning.
    """
    joined = F.array_join("lines", "\n")
    n = F.regexp_extract(joined, LOAD_LOG_ROWS_PATTERN, 1)
    errs = F.filter("lines", lambda x: (F.trim(x) != "") & ~x.contains(LOAD_LOG_SKIP_WORD))
    last_err = F.try_element_at(errs, F.lit(-1))
    return lines.select("run_id", F.when(
        F.col("ok"), F.when(n != "", F.concat(F.lit("loaded "), n, F.lit(" rows"))).otherwise(F.lit("loaded"))
    ).otherwise(F.concat(F.lit("failed: "), F.coalesce(last_err, F.lit("unknown error")))).alias("message"))


def load_history(log: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first, minute-formatted time, first ``limit`` rows."""
    order = [F.col("created_at").desc()] + ([F.col("id").desc()] if "id" in log.columns else [])
    return log.orderBy(*order).limit(limit).select(
        minute_text("created_at").alias("time"), "label", "filename",
        F.col("size_bytes").alias("size"), "state", "message", "operator")
