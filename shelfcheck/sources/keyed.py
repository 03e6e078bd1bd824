"""Keyed tables with merge-on-read: a change costs what it touches, not the table.

Rows lie in hash buckets of the key. A version names, per bucket, one base folder and the
change folders after it, in order; it is a small JSON file, a few entries per bucket. ``append`` writes
a batch of changes beside the bases and publishes the next version. ``read`` merges the
changes of the buckets that have some and passes the others as they are. ``compact`` writes
the merged buckets as new bases. ``vacuum`` deletes what no kept version names.

The table's rule is a function merge(rows, changes) -> rows, where ``changes`` carries
``_version``, the version that brought each row. Keys must be bucket-local: the rule may not
need rows of another bucket. A null key is a key like any other.

A version is visible once its file has been renamed to its number, so a failed run leaves the
former version current, and writing a version that exists does nothing, which makes a replay (a streaming
batch that runs again) harmless. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfcheck.sources.files import Files


class Pointer(NamedTuple):
    """One folder of a bucket: its base (part 0) or its n-th changes, added by a version."""

    bucket: int
    part: int
    added: int
    path: str


Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """``columns`` of the rows and ``changes`` of the change rows are DDL; both hold ``key``."""

    def __init__(self, spark: SparkSession, root: str, merge: Merge, columns: str, changes: str, key: str,
                 buckets: int | None = None):
        self.spark, self.root, self.merge, self.files = spark, root.rstrip("/"), merge, Files(spark)
        layout = self.files.get(f"{self.root}/_layout")
        if layout is None:
            layout = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "key": key,
                      "columns": columns, "changes": changes}
            self.files.put(f"{self.root}/_layout", layout)
        self.buckets, self.key = layout["buckets"], layout["key"]
        self.columns, self.changes = StructType.fromDDL(layout["columns"]), StructType.fromDDL(layout["changes"])

    # ------------------------------------------------------------ versions

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """The versions there are, oldest first."""
        return self.files.numbered(f"{self.root}/_versions")

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def _named(self, version: int) -> list[Pointer]:
        return [Pointer(*x) for x in self.files.get(f"{self.root}/_versions/{version}")]

    def pointers(self, before: int | None = None) -> list[Pointer]:
        """The folders of the newest version (below ``before``, if given)."""
        known = [v for v in self.versions() if before is None or v < before]
        return self._named(known[-1]) if known else []

    def _publish(self, version: int, pointers: list[Pointer]) -> None:
        self.files.put(f"{self.root}/_versions/{version}", sorted(pointers))

    def _write(self, version: int, rows: DataFrame) -> dict[int, str]:
        """Rows in one folder per bucket; the folders that came to be."""
        path = f"{self.root}/data/{version}-{uuid.uuid4().hex[:12]}"
        rows.withColumn("_bucket", self.bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(path)
        return {int(n.split("=")[1]): f"{path}/{n}" for n in self.files.names(path, folders=True) if n.startswith("_bucket=")}

    # ------------------------------------------------------------ reading

    def _load(self, paths: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _changes(self, pointers: list[Pointer]) -> DataFrame:
        wide = StructType([*self.changes.fields]).add("_version", "long")
        return self._load([p.path for p in pointers if p.part], wide)

    def _merged(self, pointers: list[Pointer]) -> DataFrame:
        base = self._load([p.path for p in pointers if not p.part], self.columns)
        return self.merge(base, self._changes(pointers)).select(*self.columns.names)

    def read(self, before: int | None = None) -> DataFrame:
        pointers = self.pointers(before)
        changed = {p.bucket for p in pointers if p.part}
        clean = self._load([p.path for p in pointers if p.bucket not in changed], self.columns)
        if not changed:
            return clean
        return clean.unionByName(self._merged([p for p in pointers if p.bucket in changed]))

    def lookup(self, value) -> DataFrame:
        """The rows of one key: one bucket is read."""
        own = self.spark.range(1).select(F.lit(value).cast(self.columns[self.key].dataType).alias(self.key)).select(self.bucket()).first()[0]
        pointers = [p for p in self.pointers() if p.bucket == own]
        return self._merged(pointers).where(F.col(self.key).eqNullSafe(F.lit(value)))

    # ------------------------------------------------------------ writing

    def _next(self, version: int | None) -> int | None:
        """The version to write, or None where it (or a later one) is there already."""
        last = self.version()
        if version is None:
            return 0 if last is None else last + 1
        return version if last is None or version > last else None

    def replace(self, rows: DataFrame, version: int | None = None) -> None:
        """All rows anew (the first load, or a full reload)."""
        at = self._next(version)
        if at is not None:
            self._publish(at, [Pointer(b, 0, at, p) for b, p in self._write(at, rows.select(*self.columns.names)).items()])

    def append(self, changes: DataFrame, version: int | None = None, compact_after: int | None = None) -> None:
        """A batch of changes as the next version. Buckets that then hold more than
        ``compact_after`` change folders are compacted in the same version."""
        at = self._next(version)
        if at is None:
            return
        rows = changes.select(*self.changes.names, F.lit(at).cast("long").alias("_version"))
        held = self.pointers(at)
        last = {p.bucket: p.part for p in sorted(held)}
        held += [Pointer(b, last.get(b, 0) + 1, at, path) for b, path in self._write(at, rows).items()]
        if compact_after is not None:
            count = Counter(p.bucket for p in held if p.part)
            held = self._compacted(at, held, {b for b, n in count.items() if n > compact_after})
        self._publish(at, held)

    def _compacted(self, at: int, held: list[Pointer], chosen: set[int]) -> list[Pointer]:
        if not chosen:
            return held
        made = self._write(at, self._merged([p for p in held if p.bucket in chosen]))
        return [p for p in held if p.bucket not in chosen] + [Pointer(b, 0, at, path) for b, path in made.items()]

    def compact(self) -> None:
        """Every bucket with changes gets a new base."""
        at, held = self._next(None), self.pointers()
        self._publish(at, self._compacted(at, held, {p.bucket for p in held if p.part}))

    def vacuum(self, keep: int = 2) -> None:
        """Delete the versions before the last ``keep`` and the folders only they name. Not while
        a reader still works on one of them."""
        versions = self.versions()
        kept = versions[-keep:]
        named = {p.path for v in kept for p in self._named(v)}
        for v in versions[:-keep]:
            self.files.delete(f"{self.root}/_versions/{v}")
        for write in self.files.names(f"{self.root}/data", folders=True):
            if not kept or int(write.split("-")[0]) > kept[-1]:
                continue  # a write under way
            parts = [f"{self.root}/data/{write}/{name}" for name in self.files.names(f"{self.root}/data/{write}", folders=True)]
            if not named & set(parts):
                self.files.delete(f"{self.root}/data/{write}")
            else:
                for part in set(parts) - named:
                    self.files.delete(part)
