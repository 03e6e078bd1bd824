"""I1 for workbooks: xlsx sheets as a Spark data source, one task per workbook, row by row.

A workbook is a zip of XML parts. The sheet is parsed as a stream, so a task holds one row of
it at a time, and beside it the workbook's shared strings and number formats. Every cell comes
as text, as in the CSV export of the sheet: whole numbers without ``.0``, dates (cells whose
number format shows a date) as ``yyyy-MM-dd HH:mm:ss``, errors as null. Rows without any value
are left out. The first row with a value holds the headers.

Files are opened through Arrow's file systems on the executors, so paths must be URIs these
know (file, hdfs, s3, gs). Old binary ``.xls`` files are not read.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from urllib.parse import quote
from xml.etree.ElementTree import iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfcheck.session import ship_package

# Fixed values of the format: namespaces, and the built-in number formats that show dates.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def file_system(uri: str):
    """(file system, path) of a file or folder that every executor reaches."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition(":/")
    if not sep or scheme == "file":  # Hadoop writes such paths as they are, not as URIs
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if sep else uri
    return fs.FileSystem.from_uri(f"{scheme}:/{quote(rest, safe='/:@%')}")


def workbooks(path) -> list[str]:
    """The files of a path, a folder or a list of these; raises where one is not there."""
    from pyarrow import fs

    out = []
    for p in [path] if isinstance(path, str) else path:
        system, at = file_system(p)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        if info.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(at))
            out += sorted(f"{p.rstrip('/')}/{f.base_name}" for f in inside if f.base_name.endswith(".xlsx"))
        else:
            out.append(p)
    return out


# ---------------------------------------------------------------- parts of a workbook

def _elements(stream, tag: str) -> Iterator:
    """Every element ``tag`` of a part; what its parent holds is forgotten before the next one."""
    open_now: list = []
    for event, e in iterparse(stream, events=("start", "end")):
        if event == "start":
            open_now.append(e)
            continue
        open_now.pop()
        if e.tag == tag:
            yield e
            if open_now:
                del open_now[-1][:]


def _text(e) -> str:
    """The text of a string item: its own and its runs', without phonetic hints."""
    own = e.findall(f"{_MAIN}t") + e.findall(f"{_MAIN}r/{_MAIN}t")
    return "".join(t.text or "" for t in own)


class Workbook:
    """One open workbook."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream)
        self.parts = set(self.zip.namelist())
        self.strings = [_text(e) for e in self._part("xl/sharedStrings.xml", f"{_MAIN}si")]
        self.dates = self._date_styles()
        self.epoch = datetime(1899, 12, 30)
        for e in self._part("xl/workbook.xml", f"{_MAIN}workbookPr"):
            if e.get("date1904") in ("1", "true"):
                self.epoch = datetime(1904, 1, 1)

    def _part(self, name: str, tag: str) -> Iterator:
        if name in self.parts:
            with self.zip.open(name) as stream:
                yield from _elements(stream, tag)

    def _date_styles(self) -> set[int]:
        """Numbers of the cell styles that show dates."""
        custom = {}
        for e in self._part("xl/styles.xml", f"{_MAIN}numFmt"):
            code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode", ""))
            custom[int(e.get("numFmtId"))] = bool(re.search(r"[ymdhs]", code, re.I))
        out = set()
        for styles in self._part("xl/styles.xml", f"{_MAIN}cellXfs"):
            for i, e in enumerate(styles.findall(f"{_MAIN}xf")):
                kind = int(e.get("numFmtId", 0))
                if custom.get(kind, kind in _DATE_FORMATS):
                    out.add(i)
        return out

    def sheet_part(self, sheet: str | None) -> str:
        """The part of the sheet of that name; the first one if none is named."""
        target = {e.get("Id"): e.get("Target") for e in self._part(
            "xl/_rels/workbook.xml.rels", "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship")}
        names = []
        for e in self._part("xl/workbook.xml", f"{_MAIN}sheet"):
            names.append(e.get("name"))
            if sheet in (None, e.get("name")):
                at = target[e.get(f"{_REL}id")]
                return at.lstrip("/") if at.startswith("/") else f"xl/{at}"
        raise ValueError(f"no sheet {sheet!r} among {names}")

    def _value(self, c) -> str | None:
        kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            inline = c.find(f"{_MAIN}is")
            return _text(inline) if inline is not None else None
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "TRUE" if v.text == "1" else "FALSE"
        if kind != "n":
            return v.text
        if int(c.get("s", 0)) in self.dates:
            return (self.epoch + timedelta(seconds=round(float(v.text) * 86400))).isoformat(" ")
        if re.fullmatch(r"-?\d+", v.text):
            return v.text
        x = float(v.text)
        return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)

    def rows(self, sheet: str | None = None) -> Iterator[list[str | None]]:
        """The cells of every row that has a value."""
        with self.zip.open(self.sheet_part(sheet)) as stream:
            for row in _elements(stream, f"{_MAIN}row"):
                cells: list[str | None] = []
                for c in row.findall(f"{_MAIN}c"):
                    ref = re.match("[A-Z]+", c.get("r", ""))
                    at = len(cells) if ref is None else reduce(lambda n, x: n * 26 + ord(x) - 64, ref[0], 0) - 1
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self._value(c) or None
                if any(x is not None for x in cells):
                    yield cells


# ---------------------------------------------------------------- the data source

class _File(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.sheet = json.loads(options["files"]), options.get("sheet")
        self.width = int(options["width"])  # 0: headers

    def partitions(self):
        return [_File(i, f) for i, f in enumerate(self.files)]

    def read(self, part: _File):
        system, at = file_system(part.path)
        with system.open_input_file(at) as stream:
            rows = Workbook(stream).rows(self.sheet)
            head = next(rows, None)
            if not self.width:
                if head is not None:
                    yield part.path, [x or "" for x in head]
                return
            for n, cells in enumerate(rows):
                yield (*(cells[:self.width] + [None] * (self.width - len(cells))), part.path, n)


class WorkbookSource(DataSource):
    """Options: ``files`` (JSON list), ``width`` (columns; 0 gives the header of every file) and
    ``sheet`` (a name; the first sheet if none)."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        width = int(self.options["width"])
        if not width:
            return "file string, names array<string>"
        return ", ".join(f"_c{i} string" for i in range(width)) + ", source_file string, source_pos bigint"

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_workbook(spark: SparkSession, path, sheet: str | None = None) -> list[tuple[list[str], list[str], DataFrame]]:
    """(header, files, frame) for each header that the workbooks of ``path`` have, largest group
    first. Frames have the headers as names and ``source_file``, ``source_pos`` beside them."""
    ship_package(spark)
    spark.dataSource.register(WorkbookSource)

    def load(files: list[str], width: int) -> DataFrame:
        options = {"files": json.dumps(files), "width": str(width)} | ({"sheet": sheet} if sheet else {})
        return spark.read.format("workbook").options(**options).load()

    groups: dict[tuple[str, ...], list[str]] = {}
    for r in load(workbooks(path), 0).collect():  # one header per workbook
        groups.setdefault(tuple(r["names"]), []).append(r["file"])
    ordered = sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))
    return [(list(names), files, load(files, len(names)).toDF(*names, "source_file", "source_pos")) for names, files in ordered]
