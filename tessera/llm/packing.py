"""Packing by power-of-two decomposition.

A document of n tokens is cut, from its start, into as many pieces of the
longest length as fit and then into one piece for each set bit of the rest.
A piece is a sequence of its own in the bucket of its length: nothing is
padded, and no sequence crosses documents.  Batches are drawn from one bucket.

Defined results: a null or empty text is one piece, its end id.  Repeated
documents are packed as often as they occur.  No rows give no pieces.  Other
columns are not read.  sequence_id is the task's number in the upper bits and
a running number in the lower 40, the same when a task runs again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released
from tessera.llm.tokens import END_ID, encoder

MOST = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
ROWS = 16_384


def cut(n: int, most: int = MOST) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; most is a power of two."""
    at = 0
    while n - at >= most:
        yield at, most
        at += most
    bit = most >> 1
    while bit:
        if (n - at) & bit:
            yield at, bit
            at += bit
        bit >>= 1


def pack(docs: DataFrame, tokenizer: str, most: int = MOST, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs (doc_id, text): SCHEMA, bucket being log2 of the length."""
    if most & (most - 1):
        raise ValueError("the longest sequence has to be a power of two")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, __name__), end_id.to_bytes(4, "little")
        sequence, names = TaskContext.get().partitionId() << 40, [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 7 + [pa.int32()]
        rows: list[tuple] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                n = len(ids) // 4
                for start, length in cut(n, most):
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, sequence, 0, length.bit_length() - 1))
                    sequence += 1
                if len(rows) >= ROWS:
                    yield full()
                    rows.clear()
        if rows:
            yield full()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(task), SCHEMA)
