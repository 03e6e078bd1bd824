"""I8 / I10 by mergeable profiles: what type inference needs of a column is counts and a maximum,
so it is kept per file and merged; a reload reads the values of new files only.

A profile is known by its file's path, time and length: a file that changed is profiled anew,
and one that is gone no longer counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcheck.sources.files import Files
from shelfcheck.sources.ingest import (
    SOURCE_COLUMNS,
    ColumnStats,
    format_values,
    infer_types,
    normalize_frame,
    open_export,
    stat_values,
)

STATS = [f.name for f in fields(ColumnStats)]
STORE = ("path string, modified timestamp, length bigint, at int, column string, values bigint, present bigint, "
         "numeric bigint, whole bigint, largest double, coded bigint, integer_text bigint, dated bigint")


def file_profiles(df: DataFrame) -> DataFrame:
    """(source_file, at, column, counts): one row per file and column, from one pass. ``at`` is
    the column's place. Needs ``SOURCE_COLUMNS``."""
    cols = [c for c in df.columns if c not in SOURCE_COLUMNS]
    named = [F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), *[v.alias(n) for n, v in zip(STATS, stat_values(f"`{c}`"))])
             for i, c in enumerate(cols)]
    per_file = df.groupBy("source_file").agg(*[s.alias(f"c{i}") for i, s in enumerate(named)])
    return per_file.select("source_file", F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cols))])))


def listing(spark: SparkSession, path) -> DataFrame:
    """(path, modified, length) of the files there are; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.col("modificationTime").alias("modified"), "length")


class ProfileStore:
    """The profiles of one export's files, below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def known(self) -> DataFrame:
        if not Files(self.spark).exists(f"{self.root}/profiles"):
            return self.spark.createDataFrame([], STORE)
        return self.spark.read.schema(STORE).parquet(f"{self.root}/profiles")

    def add_new(self, path, read: Callable[[list[str]], DataFrame]) -> list[str]:
        """Profile the files without a profile; ``read`` gives the frame of some files, with
        ``SOURCE_COLUMNS``. Returns their names."""
        id_cols = ["path", "modified", "length"]
        new = listing(self.spark, path).join(self.known().select(*id_cols).distinct(), id_cols, "left_anti")
        files = sorted((r["path"], r["modified"], r["length"]) for r in new.collect())  # names only
        if files:
            ids = self.spark.createDataFrame(files, "path string, modified timestamp, length bigint")
            made = file_profiles(read([f[0] for f in files])).join(F.broadcast(ids), F.col("source_file") == F.col("path"))
            made.select(*self.known().columns).write.mode("append").parquet(f"{self.root}/profiles")
        return [f[0] for f in files]

    def merged(self, path) -> dict[str, ColumnStats]:
        """The stats of every column over the files there are now: what ``column_stats`` gives of
        the whole export. A column that some files lack is null there."""
        now = self.known().join(listing(self.spark, path), ["path", "modified", "length"], "left_semi")
        sums = [F.max(n) if n == "largest" else F.sum(n) for n in STATS]
        rows = now.groupBy("column").agg(F.min("at").alias("at"), *[s.alias(n) for s, n in zip(sums, STATS)]).collect()
        return {r["column"]: ColumnStats(*[r[n] for n in STATS]) for r in sorted(rows, key=lambda r: (r["at"], r["column"]))}


def typed_export(spark: SparkSession, path, store: ProfileStore, **options) -> tuple[DataFrame, dict[str, str]]:
    """A CSV export of many files with its inferred types (I8, I9): values of files known to the
    store are not read to infer them."""
    def read(paths):
        return normalize_frame(open_export(spark, paths, ordered=True, **options).frame)

    store.add_new(path, read)
    types = infer_types(None, store.merged(path))
    return format_values(normalize_frame(open_export(spark, path, **options).frame), types), types
