"""Folders that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder stands in where that is not set and all is one process, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def named_path(spark: SparkSession, name: str) -> str:
    """The same path for the same name."""
    return f"{_root(spark)}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; a missing one holds nothing."""
    fs, where = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _files(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under a name that nobody has taken yet: whole or not at all; False where it was taken."""
    fs, where = _files(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex[:12]}")
    fs.mkdirs(where.getParent())
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, where, options)
    except Exception as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


_STORED: list[str] = []


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows from a new table in the shared folder, so that those who read them more than once do not make them anew; it stays until drop_stored()."""
    path = shared_path(rows.sparkSession, name)
    _STORED.append(path)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Deletes the tables that this driver has stored so far; what still reads them fails."""
    paths = list(_STORED)
    for path in paths:
        remove(spark, path)
    _STORED.clear()
    return len(paths)
