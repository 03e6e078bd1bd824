"""Small files beside tables, through Hadoop's file systems as Spark sees them: the few facts a
table needs of itself (its layout, its versions) as JSON, whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        """(file system, path)."""
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def names(self, path: str, folders: bool = False) -> list[str]:
        """Names of the files (or folders) in a folder; none where there is no folder."""
        fs, at = self._at(path)
        return [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory() == folders] if fs.exists(at) else []

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def make(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def put(self, path: str, value) -> None:
        """Written under another name first, then renamed."""
        fs, at = self._at(path)
        _, draft = self._at(f"{path}.{uuid.uuid4().hex[:12]}.draft")
        out = fs.create(draft)
        out.write(json.dumps(value).encode())
        out.close()
        if not fs.rename(draft, at):
            fs.delete(draft, False)
            raise FileExistsError(path)

    def get(self, path: str):
        """The value, or None where there is no such file."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def numbered(self, path: str) -> list[int]:
        """The numbers that name files in a folder, rising."""
        return sorted(int(n) for n in self.names(path) if n.isdigit())
