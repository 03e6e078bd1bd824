"""Bucketed tables below a shared folder: joins and sums on the bucket keys read them without
a shuffle, and an equality on a single bucket key reads one bucket.

Files lie in the folder named by the newest entry of a small log; a session declares the
table over that folder, so it outlives sessions without a metastore. Appending adds a file
per bucket and partition at most. ``compact`` writes all buckets anew, one sorted file each,
into a new folder and then logs it, so a reader or a failed run only ever sees whole versions.
One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shelfcheck.sources.files import Files


class Bucketed:
    """One table: ``columns`` (DDL), bucketed and sorted by ``keys``; ``partitions`` names the
    columns (the last ones) that get a folder per value."""

    def __init__(self, spark: SparkSession, path: str, entry: dict):
        self.spark, self.path, self.entry = spark, path, entry
        self.buckets, self.keys = entry["buckets"], entry["keys"].split(",")
        self.partitions = [p for p in entry["partitions"].split(",") if p]
        self.name = f"bucketed_{entry['folder'].replace('-', '_')}"
        parted = f"PARTITIONED BY ({entry['partitions']})" if self.partitions else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({entry['columns']}) USING parquet {parted} "
                  f"CLUSTERED BY ({entry['keys']}) SORTED BY ({entry['keys']}) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{path}/{entry['folder']}'")

    @classmethod
    def open(cls, spark: SparkSession, path: str, columns: str, keys: str | Sequence[str], buckets: int | None = None,
             partitions: Sequence[str] = ()) -> Bucketed:
        """The table at ``path``; created with ``buckets`` (the session's shuffle partitions if
        not given) where there is none."""
        log = Files(spark).numbered(f"{path}/_log")
        if log:
            return cls(spark, path, Files(spark).get(f"{path}/_log/{log[-1]}"))
        entry = {"version": 0, "folder": f"v0-{uuid.uuid4().hex[:12]}", "columns": columns,
                 "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")),
                 "keys": keys if isinstance(keys, str) else ",".join(keys), "partitions": ",".join(partitions)}
        Files(spark).make(f"{path}/{entry['folder']}")
        table = cls(spark, path, entry)
        table._log()
        return table

    def _log(self) -> None:
        Files(self.spark).put(f"{self.path}/_log/{self.entry['version']}", self.entry)

    def frame(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        if self.partitions:  # what other sessions have added
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, placed: bool = False) -> None:
        """``placed``: the rows already lie in ``buckets`` partitions by the keys."""
        rows = rows.select(*self.spark.table(self.name).columns)
        if not placed:
            rows = rows.repartition(self.buckets, *self.keys)
        rows.write.insertInto(self.name)

    def compact(self, buckets: int | None = None) -> Bucketed:
        """All rows in one sorted file per bucket (and partition); the way to more buckets as a
        table grows."""
        version = self.entry["version"] + 1
        entry = {**self.entry, "version": version, "folder": f"v{version}-{uuid.uuid4().hex[:12]}",
                 "buckets": buckets or self.buckets}
        new = Bucketed(self.spark, self.path, entry)
        new.append(self.frame())
        new._log()
        return new
