"""Pieces the operators share: shared tables, Arrow access, string hashing."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What separates words: space and the ASCII controls from tab to return.
SPACE = r"[\x20\x09-\x0D]+"
#: A word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

_SESSION_DIR: dict[str, str] = {}
_WRITTEN: list[str] = []
#: Tables stored since the innermost settled() began.
_OPEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("open", default=None)
#: What modules remember in a Python worker between tasks, by module name.
KEPT: dict[str, dict] = {}


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is missing and driver and executors are one
    process, as in local tests, a fresh temporary folder stands in for it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SESSION_DIR:
        _SESSION_DIR[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _SESSION_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def parts_for(df: DataFrame, each: int = 1 << 22, factor: int = 4) -> int:
    """How many parts to deal what is derived from df over.

    `factor` times the session's shuffle partitions, so that parts which meet
    in one task stay small; more where the files read hold more than `each`
    bytes a part.  An estimate of Catalyst's that no file stands behind counts
    at most 16 times as much.
    """
    least = factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(16 * least, size // each)) if size < 1 << 60 else least


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows read back from a new table in the shared folder, and its path."""
    path = new_path(df.sparkSession, name)
    _WRITTEN.append(path)
    if (own := _OPEN.get()) is not None:
        own.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows go to a table in the shared folder and are read back.

    Results are lazy and may read the table at any time, so it stays until
    drop_written().
    """
    return stored(df, name)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """Stores what `make` returns, as stored() does, and deletes the tables that it stored on its way there."""
    own: list[str] = []
    before = _OPEN.set(own)
    try:
        df, path = stored(make(), name)
    finally:
        _OPEN.reset(before)
    for other in own:
        if other != path:
            drop(df.sparkSession, other)
    if (outer := _OPEN.get()) is not None:
        outer.append(path)
    return df, path


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that this driver has stored so far; what still reads them fails."""
    paths = list(_WRITTEN)
    for path in paths:
        drop(spark, path)
    return len(paths)


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The task, after which the Python worker gives memory that it no longer uses back to the system.

    Workers outlive their tasks, and a plan keeps several of them at once.
    What another module remembers there goes before the task begins.
    """

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, kept in KEPT.items():
            if owner != task.__module__:
                kept.clear()
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, or those of a binary one, and its n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        return string_bytes(column.cast(pa.large_string()))
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of at most `most` bytes; a longer row is its own run."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer over 64 bits (xor-shift-multiply), a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Word hashes of a run of documents, vectorised over the whole run.

    A word's hash is a polynomial over its bytes modulo 2**64, taken from
    prefix sums and mixed.  ASCII capitals count as small letters.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    BLOCK = 1 << 20

    def __init__(self) -> None:
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)
        rule = np.arange(256, dtype=np.uint64)
        self._value = mix64(rule * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        self._value[65:91] = self._value[97:123]
        self._blank = np.zeros(256, bool)
        self._blank[[32, *range(9, 14)]] = True

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("_up", self.BASE), ("_down", self.INVERSE)):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, n+1 word offsets of the documents)

        Long runs are taken a block at a time, cut at blanks, so that a very
        long document needs little more memory than its words' hashes.
        """
        offsets = offsets - offsets[0]
        hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while at < len(data):
            end = min(at + self.BLOCK, len(data))
            while end < len(data) and not self._blank[data[end]]:
                rest = self._blank[data[end : end + self.BLOCK]]
                end += int(rest.argmax()) if rest.any() else len(rest)
            own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, side="right")]
            found, places = self._block(data[at:end], own - at)
            hashes.append(found)
            starts.append(places + at)
            at = end
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)

    def _block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of every word; no word crosses a cut."""
        n = len(data)
        inside = ~self._blank[data]
        cut = np.zeros(n + 1, bool)
        cut[cuts] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self._powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self._value[data] * self._up[:n], out=total[1:])
            return mix64((total[stop] - total[start]) * self._down[start]), start
