"""I14 as a Spark data source, batch and stream: landed API pages, one partition per some files.

Pages land as one JSON file each in a folder per pull, below one landing folder; pulls are
ordered by their folders' names. The source yields (source_file, pull, value), the page's text;
parsing and the rows are Spark's (``parsed`` and ``pages.inventory_rows``).

The stream's offset is the name of the newest pull that has landed whole, as far as the files
show: as many pages as one of them states. A pull still landing holds nothing up: when a newer
one is whole it is passed over for good, since each pull is the whole stock. Whether a pull is
complete in the sense of I15 (no page rejected, none missing) is for the sink to check.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from shelfcheck.session import ship_package
from shelfcheck.sources.pages import PAGE_SCHEMA
from shelfcheck.sources.xlsx import file_system

FILES_PER_PARTITION = 16
SCHEMA = "source_file string, pull string, value string"


class _Files(InputPartition):
    def __init__(self, pull: str, files: list[str]):
        self.pull, self.files = pull, files


class Landing:
    """The landing folder: one folder per pull."""

    def __init__(self, options: dict):
        self.uri = options["path"].rstrip("/")
        self.system, self.at = file_system(self.uri)

    def _entries(self, at: str, files: bool) -> list[str]:
        from pyarrow import fs

        kind = fs.FileType.File if files else fs.FileType.Directory
        inside = self.system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(f.base_name for f in inside if f.type == kind and not f.base_name.startswith(("_", ".")))

    def pulls(self) -> list[str]:
        return self._entries(self.at, files=False)

    def pages(self, pull: str) -> list[str]:
        return self._entries(f"{self.at}/{pull}", files=True)

    def text(self, pull: str, page: str) -> str:
        with self.system.open_input_file(f"{self.at}/{pull}/{page}") as f:
            return f.read().decode("utf-8", "replace")

    def whole(self, pull: str) -> bool:
        """As many pages as the first one that can be read states."""
        pages = self.pages(pull)
        for page in pages:
            try:
                total = json.loads(self.text(pull, page))["data"]["totalPage"]
                return len(pages) >= int(total)
            except (ValueError, KeyError, TypeError):
                continue
        return False

    def partitions(self, pulls: list[str]) -> list[_Files]:
        out = []
        for pull in pulls:
            pages = self.pages(pull)
            out += [_Files(pull, pages[i:i + FILES_PER_PARTITION]) for i in range(0, len(pages), FILES_PER_PARTITION)]
        return out

    def read(self, part: _Files):
        for page in part.files:
            yield f"{self.uri}/{part.pull}/{page}", f"{self.uri}/{part.pull}", self.text(part.pull, page)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        landing = Landing(self.options)
        return landing.partitions(landing.pulls()) or [_Files("", [])]

    def read(self, partition):
        yield from Landing(self.options).read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"pull": ""}

    def latestOffset(self):
        landing = Landing(self.options)
        return {"pull": next((p for p in reversed(landing.pulls()) if landing.whole(p)), "")}

    def partitions(self, start, end):
        landing = Landing(self.options)
        new = [p for p in landing.pulls() if start["pull"] < p <= end["pull"] and (p == end["pull"] or landing.whole(p))]
        return landing.partitions(new) or [_Files("", [])]

    def read(self, partition):
        yield from Landing(self.options).read(partition)

    def commit(self, end):
        pass


class PagesSource(DataSource):
    """``spark.read`` / ``readStream.format("inventory_pages").load(landing folder)``."""

    @classmethod
    def name(cls):
        return "inventory_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(dict(self.options))

    def streamReader(self, schema):
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(PagesSource)


def parsed(raw: DataFrame) -> DataFrame:
    """The source's rows in the form of ``pages.read_pages``."""
    return raw.select("source_file", "pull", F.from_json("value", PAGE_SCHEMA).alias("page"))


def read_landing(spark: SparkSession, landing: str) -> DataFrame:
    """All pulls of a landing folder, as ``pages.read_pages`` gives them."""
    register(spark)
    return parsed(spark.read.format("inventory_pages").load(landing))


def stream_landing(spark: SparkSession, landing: str) -> DataFrame:
    register(spark)
    return parsed(spark.readStream.format("inventory_pages").load(landing))
