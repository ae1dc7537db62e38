"""Small metadata files with a create that fails if the file exists: the compare-and-swap of all commits.

Local folders use a hard link of a finished temporary file. Other file systems go
through Hadoop, whose rename without overwrite is the same step there.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        at = urlparse(root)
        self.local = at.scheme in ("", "file")
        self.root = (at.path if self.local else root).rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, path: str, data: bytes) -> bool:
        """Whether the file came into being; if not, another writer was first."""
        if self.local:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            temporary = f"{path}.{uuid.uuid4().hex}.tmp"
            with open(temporary, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temporary, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(temporary)
            return True
        jvm, p, fs = self._hadoop(path)
        fs.mkdirs(p.getParent())
        temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, False)
        out.write(bytearray(data))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temporary, p, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                fs.delete(temporary, False)
                return False
            raise
        return True

    def read(self, path: str) -> bytes:
        if self.local:
            with open(path, "rb") as f:
                return f.read()
        jvm, p, fs = self._hadoop(path)
        stream = fs.open(p)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def list(self, path: str) -> list[tuple[str, int, float]]:
        """(path, bytes, seconds since 1970 of the last change) of all files below."""
        if self.local:
            found = []
            for folder, _, names in os.walk(path):
                for n in names:
                    s = os.stat(f"{folder}/{n}")
                    found.append((f"{folder}/{n}", s.st_size, s.st_mtime))
            return sorted(found)
        _, p, fs = self._hadoop(path)
        if not fs.exists(p):
            return []
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime() / 1000))
        return sorted(found)

    def names(self, path: str) -> list[str]:
        if self.local:
            return sorted(os.listdir(path)) if os.path.isdir(path) else []
        _, p, fs = self._hadoop(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        if self.local:
            if os.path.exists(path):
                os.unlink(path)
            return
        _, p, fs = self._hadoop(path)
        fs.delete(p, False)
