"""Token ids as flat unsigned integer files with 64-bit document offsets.

A data set is a folder of shards.  A shard has ``.bin`` (ids in the narrowest
unsigned type that holds the vocabulary), ``.idx`` (n+1 offsets into it, 64
bits) and ``.doc`` (document ids).  A shard's place in the whole comes from
prefix sums over the shards' counts, so no task waits for another.

Defined results: a null text is an empty one, and every document gets at least
its end id.  Repeated doc_ids are kept, ordered by text; null doc_ids come
first.  An empty table gives a data set without shards.  Other columns are not
read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import KEPT, released

END_ID = 2
DOC = np.dtype([("id", "<i8"), ("null", "u1")])
MANIFEST = "part int, shard string, docs long, tokens long"


class WordEncoder:
    """Encodes whole texts, a blank-separated piece at a time.

    The tokenizer's rules never join characters across a space or a line end,
    so a text's ids are its pieces' ids in order; pieces repeat, and their ids
    are remembered.  The memory is bounded in entries and in piece length.  A
    piece of plain Latin letters, perhaps with a stop or comma behind, is one
    word to the rules: it goes to the library's model directly.
    """

    WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")

    def __init__(self, path: str, entries: int = 700_000, longest: int = 48) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        encode, model, known, word = tokenizer.encode, tokenizer.model, {"": b""}, self.WORD.fullmatch
        letters = {ord(c): "".join(p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(c))) for c in map(chr, range(65, 256)) if word(c)}
        behind = {c: tuple(encode(c, add_special_tokens=False).ids) for c in ".,"} | {"": ()}

        def ids_of(piece: str) -> bytes:
            if plain := word(piece):
                return array("I", [*(t.id for t in model.tokenize(plain[1].translate(letters))), *behind[plain[2]]]).tobytes()
            return array("I", encode(piece, add_special_tokens=False).ids).tobytes()

        class Memory(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = ids_of(piece)
                if len(piece) <= longest:
                    if len(self) >= entries:
                        self.clear()
                        self.update(known)
                    self[piece] = ids
                return ids

        self._ids = Memory(known).__getitem__

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._ids, text.replace("\n", " ").split(" "))) if text else b""


def encoder(path: str, owner: str = __name__) -> WordEncoder:
    """One for each Python worker, so that what it remembers outlives a task; it goes when another module's task begins."""
    kept = KEPT.setdefault(owner, {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def vocabulary_dtype(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), END_ID + 1) <= 1 << 16 else "<u4"


def _put(fs: pafs.FileSystem, path: str, parts: Iterable[bytes]) -> None:
    with fs.open_output_stream(path) as out:
        for part in parts:
            out.write(part)


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs (doc_id, text) below `root` in ascending doc_id order.

    Returns one row per shard (MANIFEST).  The rows are lazy: a caller stores
    them once.  A shard's files carry a name of their own attempt, so a task
    that runs twice leaves its first files unnamed by the manifest.
    """
    dtype = vocabulary_dtype(tokenizer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, folder = pafs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        shard, encode = f"shard-{part:06d}-{uuid.uuid4().hex[:8]}", encoder(tokenizer)
        end = np.asarray([end_id], "<u4").astype(dtype).tobytes()
        counts, ids = [np.zeros(1, "<i8")], []
        with fs.open_output_stream(f"{folder}/{shard}.bin", buffer_size=1 << 20) as out:
            for batch in batches:
                lengths = np.empty(batch.num_rows, "<i8")
                for i, text in enumerate(batch.column("text")):
                    found = np.frombuffer(encode(text.as_py()), "<u4").astype(dtype).tobytes()
                    out.write(found + end)
                    lengths[i] = len(found) // len(end) + 1
                named = np.empty(batch.num_rows, DOC)
                column = batch.column("doc_id").cast(pa.int64())
                named["null"], named["id"] = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()
                counts.append(lengths)
                ids.append(named)
        offsets = np.cumsum(np.concatenate(counts))
        if len(offsets) == 1:
            fs.delete_file(f"{folder}/{shard}.bin")
            return
        _put(fs, f"{folder}/{shard}.idx", [offsets.astype("<i8").tobytes()])
        _put(fs, f"{folder}/{shard}.doc", [x.tobytes() for x in ids])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": [shard], "docs": [len(offsets) - 1], "tokens": [int(offsets[-1])]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(released(task), MANIFEST)


def with_bases(manifest: list) -> list[tuple[str, int, int]]:
    """(shard, tokens before it, its documents): prefix sums over the shards in order."""
    out, base = [], 0
    for row in sorted(manifest, key=lambda r: r["part"]):
        out.append((row["shard"], base, row["docs"]))
        base += row["tokens"]
    return out


class Shard:
    """A shard by memory map where its folder is a local one."""

    def __init__(self, root: str, shard: str, dtype: str) -> None:
        fs, folder = pafs.FileSystem.from_uri(root)

        def read(kind: str, as_type) -> np.ndarray:
            path = f"{folder}/{shard}.{kind}"
            if isinstance(fs, pafs.LocalFileSystem):
                return np.memmap(path, as_type, "r")
            with fs.open_input_file(path) as f:
                return np.frombuffer(f.read(), as_type)

        self.ids, self.offsets, self.docs = read("bin", dtype), read("idx", "<i8"), read("doc", DOC)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_token_files(spark: SparkSession, root: str, shards: list[tuple[str, int, int]], tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    `shards` is as long as the number of shards, not of documents.
    """
    dtype = vocabulary_dtype(tokenizer)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(root, row["shard"], dtype)
                for i in range(0, len(shard), 4096):
                    span = range(i, min(i + 4096, len(shard)))
                    named = shard.docs[span.start : span.stop]
                    at = shard.offsets[span.start : span.stop + 1]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(named["id"].copy(), mask=named["null"].astype(bool)),
                        "start": at[:-1] + row["base"],
                        "n_tokens": np.diff(at),
                        "ids_crc32": pa.array([zlib.crc32(shard[k].astype("<u4").tobytes()) for k in span], pa.int64()),
                    })

    if not shards:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(s, b) for s, b, _ in shards], "shard string, base long")
    return rows.repartition(len(shards)).mapInArrow(task, schema)
