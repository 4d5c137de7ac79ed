"""Small files beside tables (manifests, placements) in any Hadoop file system."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Read, atomically replace, list and delete files through Spark's file systems."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str, over: bool) -> None:
        fs, p = self._at(path)
        _, tmp = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        kinds = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(kinds, 1)
        options[0] = kinds.getEnumConstants()[1 if over else 0]
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            context.rename(tmp, p, options)
        except Py4JJavaError:
            fs.delete(tmp, False)
            raise

    def write_text(self, path: str, text: str) -> None:
        """Write beside, then rename over: readers see the old or the new file."""
        self._put(path, text, True)

    def create_text(self, path: str, text: str) -> bool:
        """Write a file that must not be there yet; False if it is."""
        try:
            self._put(path, text, False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def read_json(self, path: str) -> Any:
        return json.loads(self.read_text(path))

    def write_json(self, path: str, value: Any) -> None:
        self.write_text(path, json.dumps(value, indent=1, sort_keys=True))

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def modified_ms(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime()

    def rename(self, old: str, new: str) -> bool:
        fs, p = self._at(old)
        fs.mkdirs(self._at(new)[1].getParent())
        return fs.rename(p, self._at(new)[1])

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)
