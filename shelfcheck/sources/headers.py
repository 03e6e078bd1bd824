"""I1 / I2 for exports of many files: the header records of all files in one pass.

Files are grouped by their header; a group is read with the names its files state, whatever
their order, and the groups are united by name. However many files there are, this takes one
job, and a second one where headers differ; only distinct headers, and then the files' names,
reach the driver.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A record up to its line end, line breaks inside quotes included.
_QUOTED_RECORD = r'^((?:[^"\r\n]++|"(?:[^"]++|"")*+")*+)'
_MARK = "\ufeff"
# A separator no text holds: the line comes out whole, in the reader's encoding.
_WHOLE_LINE = {"sep": "\u0001", "quote": "", "header": False, "inferSchema": False}


@dataclass
class HeaderGroup:
    """Files that share a header: its names as written, the files (None: all that there are)
    and their number."""

    names: list[str]
    files: list[str] | None
    count: int


def first_records(spark: SparkSession, path, multi_line: bool = False, encoding: str | None = None) -> DataFrame:
    """(file, record): the first record that is not blank of every file that has one."""
    if multi_line:
        lines = spark.read.text(path, wholetext=True).select(
            F.regexp_extract(F.regexp_replace("value", r"^\s+", ""), _QUOTED_RECORD, 1).alias("value"), "_metadata.file_path")
    else:
        raw = (spark.read.options(**_WHOLE_LINE, encoding=encoding).schema("value string").csv(path) if encoding
               else spark.read.text(path))
        lines = raw.where(F.col("_metadata.file_block_start") == 0).select("value", "_metadata.file_path")
    marked = F.col("value").startswith(_MARK)  # a file's byte order mark is no part of its text
    blank = (F.trim("value") == "") | (marked & (F.trim(F.substring("value", 2, 2**31 - 1)) == ""))
    return (lines.where(~blank).select("file_path", "value", F.monotonically_increasing_id().alias("at"))
            .groupBy(F.col("file_path").alias("file")).agg(F.min_by("value", "at").alias("record"))
            .withColumn("record", F.regexp_replace("record", f"^{_MARK}", "")))


def parse_record(record: str, sep: str = ",", quote: str = '"') -> list[str]:
    rows = csv.reader([record], delimiter=sep, quotechar=quote or None, quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE)
    return next(rows, [])


def header_groups(spark: SparkSession, path, multi_line: bool = False, **options) -> list[HeaderGroup]:
    """The groups of a CSV export, largest first."""
    sep = options.get("sep", options.get("delimiter", ","))
    firsts = first_records(spark, path, multi_line, options.get("encoding") or options.get("charset"))
    seen = firsts.groupBy("record").agg(F.count(F.lit(1)).alias("n")).collect()  # distinct headers
    by_names: dict[tuple[str, ...], list[str]] = {}
    count: dict[tuple[str, ...], int] = {}
    for r in seen:
        names = tuple(parse_record(r["record"], sep, options.get("quote", '"')))
        by_names.setdefault(names, []).append(r["record"])
        count[names] = count.get(names, 0) + r["n"]
    ordered = sorted(by_names, key=lambda n: (-count[n], n))
    if len(ordered) < 2:
        return [HeaderGroup(list(n), None, count[n]) for n in ordered]
    files: dict[str, list[str]] = {}
    for r in firsts.select("file", F.sha2("record", 256).alias("h")).collect():  # names only
        files.setdefault(r["h"], []).append(r["file"])
    own = {n: sorted(f for rec in by_names[n] for f in files.get(sha256(rec.encode()).hexdigest(), [])) for n in ordered}
    return [HeaderGroup(list(n), own[n], count[n]) for n in ordered]
