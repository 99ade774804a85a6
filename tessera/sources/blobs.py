"""Keys and bytes on any file system that Spark reaches."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def safe_key(*parts: str) -> str:
    """Parts in lower case with safe signs only, joined by slashes; an empty part becomes x."""
    return "/".join(re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9.!_-]+", "-", p.lower())) or "x" for p in parts)


class Blobs:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def _path(self, key: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self._conf), path

    def put(self, key: str, data: bytes) -> None:
        fs, path = self._path(key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        fs, path = self._path(key)
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def location(self, key: str) -> str:
        return f"{self.root}/{key}"

    def remove(self, key: str) -> None:
        fs, path = self._path(key)
        fs.delete(path, True)
