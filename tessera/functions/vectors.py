"""Vectors and hashes inside the JVM; the words of whole texts are hashed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import col

#: 32-bit FNV-1a.
BASIS, PRIME = 2166136261, 16777619
#: Bytes of texts whose words are hashed together, and the length from which words are hashed one by one.
CHUNK, LONG = 1 << 20, 64
#: Texts whose bucket counts one task adds up.
TEXTS = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; 0 with a zero vector."""
    a, b = col(a), col(b)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector])


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a over the characters of an ASCII word."""
    codes = F.transform(F.split(col(c), ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(BASIS), lambda h, b: (h.bitwiseXOR(b) * F.lit(PRIME)).bitwiseAND(F.lit(4294967295)))


def _word_hashes(letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and FNV-1a of every [a-z0-9]+ in texts that lie one behind the other and begin at `starts`."""
    word = ((letters >= 97) & (letters <= 122)) | ((letters >= 48) & (letters <= 57))
    before, behind = np.append(False, word[:-1]), np.append(word[1:], False)
    starts = starts[(starts > 0) & (starts < len(letters))]
    before[starts] = behind[starts - 1] = False
    at, size = np.flatnonzero(word & ~before), np.flatnonzero(word & ~behind) + 1
    size -= at
    order = np.argsort(-size, kind="stable")
    at, size, found = at[order], size[order], np.full(len(at), BASIS, np.uint32)
    # The longest come first, so that words that go on are the first ones.
    going = np.searchsorted(-size, -np.arange(LONG))
    for i, n in enumerate(going[going > 0].tolist()):
        found[:n] = (found[:n] ^ letters[at[:n] + i]) * np.uint32(PRIME)
    for j in range(np.searchsorted(-size, -LONG)):
        h = int(found[j])
        for letter in letters[at[j] + LONG : at[j] + size[j]].tolist():
            h = (h ^ letter) * PRIME & 0xFFFFFFFF
        found[j] = h
    return at, found


def _bucket_counts(dim: int):
    """array<struct<bucket, n>> of a text in lower case: how many of its words fall into each bucket."""

    def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bytes and starts of texts that are together about as long as CHUNK."""
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, "right")) - 1)
            yield letters[ends[i] : ends[j]], ends[i:j] - ends[i]
            i = j

    @F.arrow_udf("array<struct<bucket: int, n: bigint>>")
    def count(texts: pa.Array) -> pa.Array:
        buckets, counts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for letters, starts in chunks(texts.cast(pa.large_binary()).fill_null(b"")):
            at, found = _word_hashes(letters, starts)
            text = np.searchsorted(starts, at, "right") - 1
            cell, n = np.unique(text * dim + found % dim, return_counts=True)
            buckets.append(cell % dim)
            counts.append(n)
            sizes.append(np.bincount(cell // dim, minlength=len(starts)))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(buckets), pa.int32()), pa.array(np.concatenate(counts), pa.int64())], ["bucket", "n"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pairs)

    return count


def hash_embedding(docs: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """key, bucket, weight: the hashed bag of words of a text at unit length, in sparse form.

    Words are counted by bucket where their text lies; only counts move.  Rows
    of one key are one text.
    """
    counted = docs.select(key, F.explode(_bucket_counts(dim)(F.lower(text))).alias("__c")).select(key, "__c.bucket", "__c.n")
    # Dealt by the key alone, so that its sums and its length need no further exchange; a task's share is bounded by `dim` rows a text.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.count() // TEXTS + 1)
    buckets = counted.repartition(parts, key).groupBy(key, "bucket").agg(F.sum("n").alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return buckets.select(key, "bucket", (F.col("n") / size).alias("weight"))


def canvas_place(c: Column | str) -> Column:
    """A fixed place from 8 to 91 for a label: the signed 32-bit hash, absolute, modulo 84."""
    signed = F.when(fnv1a(c) > 2147483647, fnv1a(c) - F.lit(4294967296)).otherwise(fnv1a(c))
    return (8 + F.abs(signed) % 84).cast("int")
