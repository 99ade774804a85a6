"""SHA-256 of texts that lie in pieces over many rows.

The hash is sequential by nature: the pieces of a key pass through one task in
their order, one at a time, and only the state of the hash stays.  Callers make
pieces of many values each, so that few rows are left to pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released

#: Rows of an Arrow batch that a task yields.
ROWS = 4096


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows in batches of `most`."""
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == most:
            yield _batch(kept, schema)
            kept = []
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def hashed(pieces: DataFrame, between: str) -> DataFrame:
    """key, sha256 of pieces (key long, at long, piece string): each key's pieces by `at`, with `between` between them."""
    schema = pa.schema([("key", pa.int64()), ("sha256", pa.string())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, state = None, None
        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        yield key, state.hexdigest()
                    key, state = k, hashlib.sha256()
                else:
                    state.update(between.encode())
                state.update(piece.encode())
        if state is not None:
            yield key, state.hexdigest()

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(sums(batches), schema)

    return pieces.repartition(F.col("key")).sortWithinPartitions("key", "at").select("key", "piece").mapInArrow(task, "key long, sha256 string")
