"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are gathered from the training documents and
quantised on a logarithmic scale.  The pairs are stored in a Bloom filter: a
pair is in it once for each level up to that of its count; a count is read
back by probing level after level until one is missing.  A text's probability
interpolates the pair model with smoothed single words:

    p(w | u) = (1 - PAIR) * (c(w) + 1) / (N + V + 1) + PAIR * c(u, w) / c(u)

The filter takes every pair, those seen once too.  It is sharded by part, and
a part's bits are so many for each of its distinct pairs, so it grows with the
corpus; nowhere does it lie together.  Texts are dealt with in chunks: a chunk
asks each part for the pairs and rarer words that it has, the part answers
from its filter and its exact word counts, and the answers meet the chunk.

Words of at least 1 / FREQUENT of all tokens (no more than FREQUENT, hence
broadcast) need not be asked for.  The single-word model of base_score takes
exact counts, that of score the same counts on the scale.

Defined results: a null text is an empty one, which is one end token.  Rows
that repeat a doc_id are scored each for itself; a null doc_id counts as the
empty string where documents are set apart.  Without training tokens the
counts are 0.  Words are told apart by 64-bit hashes.  Other columns are not read.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, mix64, parts_for, released, slices, string_bytes, written

END = np.uint64(0xA0761D6478BD642F)
PAIR = 0.1
FREQUENT = 1 << 20
STEP = 1.25
#: Bits of the filter for each distinct pair.
BITS_PER_PAIR = 32
PROBES = 3
SLICE, CHUNK = 1 << 23, 1 << 20
LEVELS = 256

COUNTED = "kind int, part int, keys binary, counts binary, tokens long"
MERGED = "kind int, part int, keys binary, counts binary, bits binary, tokens long, types long"
CHUNKS = "kind int, part int, chunk long, keys binary, back binary, ids binary, nulls binary, lengths binary"
ANSWERS = "kind int, part int, chunk long, found binary"
#: What a row of CHUNKS is: a chunk's documents, or its questions for rarer words or for pairs.
CHUNK_ROW, WORD, PAIRED = -1, 0, 1
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

_EDGES = np.unique(np.ceil(STEP ** np.arange(LEVELS, dtype=np.float64)).clip(max=2.0**62).astype(np.int64))
#: The count a level stands for: the geometric middle of its range.
_MIDDLE = np.sqrt(_EDGES.astype(float) * np.append(_EDGES[1:] - 1, _EDGES[-1]).clip(min=1))
#: The same by level + 1; 0 for what has no count.
_STANDS_FOR = np.append(0.0, _MIDDLE)


def level(counts: np.ndarray) -> np.ndarray:
    """The level of a count of at least 1, from 0."""
    return np.searchsorted(_EDGES, counts, side="right") - 1


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, behind how many they are."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(data[8:], n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def packed_steps(ordered: np.ndarray) -> bytes:
    """The same of numbers in order, whose steps are smaller."""
    return packed(np.diff(ordered, prepend=ordered.dtype.type(0)))


def unpacked_steps(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpacked(data, kind), dtype=kind)


class Tokens:
    """Chunks of documents as token hashes: (hashes, offsets); each document ends in END."""

    def __init__(self) -> None:
        self.words = Words()

    def of(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        data, offsets = string_bytes(column)
        for i, j in slices(offsets, SLICE):
            hashes, at = self.words(data[offsets[i] : offsets[j]], offsets[i : j + 1])
            at = at + np.arange(j - i + 1)
            out = np.full(len(hashes) + j - i, END, np.uint64)
            mask = np.ones(len(out), bool)
            mask[at[1:] - 1] = False
            out[mask] = hashes
            yield out, at, i, j


def pairs(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; END stands before a document."""
    before = np.empty_like(tokens)
    before[:1], before[1:] = END, tokens[:-1]
    with np.errstate(over="ignore"):
        return mix64(before * np.uint64(0x2545F4914F6CDD1D) ^ tokens)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _cut(part: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(part, np.arange(parts + 1))


def count(docs: DataFrame, parts: int) -> DataFrame:
    """COUNTED: for each chunk of training text and part, its n-grams and their counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, kept, size = Tokens(), [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            stream = np.concatenate(kept)
            for kind, grams in ((0, stream), (1, pairs(stream))):
                keys, counts = np.unique(grams, return_counts=True)
                part = part_of(keys, parts)
                order = np.argsort(part, kind="stable")
                keys, counts, at = keys[order], counts[order].astype("<u4"), _cut(part[order], parts)
                full = np.flatnonzero(np.diff(at))
                as_key = "<u8" if kind == 0 else "<u4"
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.full(len(full), kind), pa.int32()),
                    "part": pa.array(full, pa.int32()),
                    "keys": [keys[at[p] : at[p + 1]].astype(as_key).tobytes() for p in full],
                    "counts": [counts[at[p] : at[p + 1]].tobytes() for p in full],
                    "tokens": pa.array([int(counts[at[p] : at[p + 1]].sum()) for p in full], pa.int64()),
                })

        for batch in batches:
            for stream, *_ in read.of(batch.column("text")):
                kept.append(stream)
                size += len(stream)
                if size >= CHUNK:
                    yield from rows()
                    kept, size = [], 0
        if size:
            yield from rows()

    return docs.select("text").mapInArrow(released(task), COUNTED)


def _by_part(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with the same values of `names`, in the order they come."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[n] for n in names)
            if now != key and rows:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def merge(counted: DataFrame, parts: int) -> DataFrame:
    """MERGED: one row for each kind and part; the words' exact counts, the pairs' filter."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, part), rows in _by_part(batches, "kind", "part"):
            keys = np.concatenate([np.frombuffer(r["keys"], "<u8" if kind == 0 else "<u4") for r in rows])
            counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
            own = {"keys": [None], "counts": [None], "bits": [None]}
            if kind == WORD:
                own |= {"keys": [keys.tobytes()], "counts": [counts.astype("<i8").tobytes()]}
            else:
                own |= {"bits": [packed(np.frombuffer(Filter(1, 0, BITS_PER_PAIR * len(keys)).stretch_of(keys.astype(np.uint64), counts), np.uint8))]}
            own = {k: pa.array(v, pa.binary()) for k, v in own.items()}
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), **own,
                "tokens": pa.array([sum(r["tokens"] for r in rows)], pa.int64()), "types": pa.array([len(keys)], pa.int64()),
            })

    return counted.repartition(2 * parts, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(released(task), MERGED)


class Filter:
    """The filter of one kind of n-grams: `parts` stretches of bits, each probed for its own keys."""

    def __init__(self, parts: int, least: int, bits: int) -> None:
        self.parts, self.least, self.stretch = parts, least, max(64, bits // parts // 64 * 64)
        self.bytes = np.zeros(parts * self.stretch // 8, np.uint8)

    def places(self, keys: np.ndarray, at: np.ndarray | int) -> Iterator[np.ndarray]:
        """Bit numbers within the stretch, for each probe, of 32-bit keys at a level."""
        with np.errstate(over="ignore"):
            h = mix64((keys & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(at).astype(np.uint64))
            step = (h >> np.uint64(32)) | np.uint64(1)
            for i in range(PROBES):
                yield ((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * step) % np.uint64(self.stretch)

    def stretch_of(self, keys: np.ndarray, counts: np.ndarray) -> bytes:
        """A part's bits with all its n-grams of a level from `least` on."""
        bits, upto = np.zeros(self.stretch, bool), level(counts)
        for at in range(self.least, int(upto.max(initial=-1)) + 1):
            for place in self.places(keys[upto >= at], at):
                bits[place] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Each n-gram's level and 1; 0 where it is not in the filter."""
        out = np.zeros(len(grams), np.uint8)
        base = part_of(grams, self.parts).astype(np.uint64) * np.uint64(self.stretch)
        left, at = np.arange(len(grams)), self.least
        while len(left) and at < len(_EDGES):
            there = np.ones(len(left), bool)
            for place in self.places(grams[left], at):
                place += base[left]
                there &= (self.bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[there]
            at += 1
            out[left] = at
        return out

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """The count that each n-gram's level stands for; 0 where it is not in the filter."""
        return _STANDS_FOR[self.levels(grams)]


class Model:
    """What goes to the workers: totals and the exact counts of frequent words."""

    def __init__(self, merged: DataFrame, parts: int) -> None:
        self.parts = parts
        words = merged.filter(F.col("kind") == WORD)
        total = words.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
        self.tokens, self.types = total["tokens"] or 0, total["types"] or 0
        least = max(1, -(-self.tokens // FREQUENT))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    keys, counts = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<i8")
                    yield pa.RecordBatch.from_pydict({"keys": [keys[counts >= least].tobytes()], "counts": [counts[counts >= least].tobytes()]})

        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for r in words.select("keys", "counts").mapInArrow(released(task), "keys binary, counts binary").collect():  # FREQUENT words at most
            keys.append(np.frombuffer(r["keys"], "<u8"))
            counts.append(np.frombuffer(r["counts"], "<i8"))
        order = np.argsort(keys := np.concatenate(keys))
        self.keys, self.counts = keys[order].astype(np.uint64), np.concatenate(counts)[order]

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Counts of frequent words; 0 for others."""
        return _looked_up(self.keys, self.counts, words)

    def questions(self, unique: np.ndarray, back: np.ndarray) -> tuple[dict[int, tuple], np.ndarray]:
        """By kind (n-grams to ask for, their order by part, where each part begins, which n-grams they are); the pair of each token."""
        rare = np.flatnonzero(self.exact(unique) == 0)
        grams, of = np.unique(pairs(unique[back]), return_inverse=True)
        out = {}
        for kind, keys, which in ((WORD, unique[rare], rare), (PAIRED, grams, np.arange(len(grams)))):
            part = part_of(keys, self.parts)
            order = np.argsort(part, kind="stable") if kind == WORD else np.lexsort((keys.astype("<u4"), part))  # as the keys travel
            out[kind] = keys[order], which[order], _cut(part[order], self.parts)
        return out, of

    def log10p(self, counts: np.ndarray, back: np.ndarray, both: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the one before it; `counts` of the words that `back` numbers, `both` of the pairs."""
        single = np.where(counts > 0, _MIDDLE[level(np.maximum(counts, 1))], 0.0)
        words = (single + 1) / (self.tokens + self.types + 1)
        before = np.empty(len(back))
        before[1:] = single[back[:-1]]
        before[:1] = single[back[-1:]]  # a chunk ends in END
        follows = np.where(before > 0, np.minimum(1.0, both / np.maximum(before, 1.0)), 0.0)
        return np.log10((1 - PAIR) * words[back] + PAIR * follows)


def _looked_up(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The counts of sorted keys; 0 for what is not among them."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.searchsorted(keys, asked).clip(max=len(keys) - 1)
    return np.where(keys[at] == asked, counts[at], 0)


def chunks(docs: DataFrame, model) -> DataFrame:
    """CHUNKS: each chunk's documents, and its questions for the parts."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5

    def row(**x) -> list:
        return [x.get(n) for n in names]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, chunk, m = Tokens(), TaskContext.get().partitionId() << 32, model.value
        for batch in batches:
            ids = batch.column("doc_id")
            for stream, at, i, j in read.of(batch.column("text")):
                unique, back = np.unique(stream, return_inverse=True)
                own = ids.slice(i, j - i)
                rows = [row(kind=CHUNK_ROW, part=-1, chunk=chunk, keys=packed_steps(unique.astype("<u8")), back=packed(back.astype("<u4")), ids=own.fill_null(0).to_numpy().astype("<i8").tobytes(), nulls=own.is_null().to_numpy(zero_copy_only=False).tobytes(), lengths=np.diff(at).astype("<i8").tobytes())]
                if m.tokens:
                    for kind, (keys, _, edges) in m.questions(unique, back)[0].items():
                        keys = keys.astype("<u8" if kind == WORD else "<u4")
                        rows += [row(kind=kind, part=int(p), chunk=chunk, keys=packed_steps(keys[edges[p] : edges[p + 1]])) for p in np.flatnonzero(np.diff(edges))]
                chunk += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(task), CHUNKS)


def answers(asked: DataFrame, merged: DataFrame, parts: int) -> DataFrame:
    """ANSWERS: for each question the counts of its words, or the levels of its pairs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            out = {"kind": [], "part": [], "chunk": [], "found": []}
            for r in batch.to_pylist():
                kind, key = r["kind"], (r["kind"], r["part"])
                if r["role"] == 0:
                    now = key
                    if kind == WORD:
                        known = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<i8")
                    else:
                        bits = unpacked(r["bits"], "u1")
                        known = Filter(1, 0, 8 * len(bits))
                        known.bytes = bits
                    continue
                if now != key:
                    continue  # nothing of this part was in training
                if kind == WORD:
                    found = _looked_up(*known, unpacked_steps(r["keys"], "<u8")).astype("<u4")
                else:
                    found = known.levels(unpacked_steps(r["keys"], "<u4").astype(np.uint64))
                for k, v in (("kind", kind), ("part", r["part"]), ("chunk", r["chunk"]), ("found", packed(found))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(out["kind"], pa.int32()), "part": pa.array(out["part"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int64()), "found": pa.array(out["found"], pa.binary())})

    asked = asked.filter(F.col("kind") != CHUNK_ROW).select("kind", "part", F.lit(1).alias("role"), "chunk", "keys")
    known = merged.select("kind", "part", F.lit(0).alias("role"), "keys", "counts", "bits")
    return asked.unionByName(known, allowMissingColumns=True).repartition(2 * parts, "kind", "part").sortWithinPartitions("kind", "part", "role").mapInArrow(released(task), ANSWERS)


def gather(asked: DataFrame, answered: DataFrame, model) -> DataFrame:
    """The rows of RESULT but held_out, from each chunk and the answers to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for _, rows in _by_part(batches, "chunk"):
            r = rows[0]
            unique, back, length = unpacked_steps(r["keys"], "<u8"), unpacked(r["back"], "<u4"), np.frombuffer(r["lengths"], "<i8")
            places, of = m.questions(unique, back)
            counts, levels = m.exact(unique), np.zeros(int(of.max()) + 1, np.uint8)
            for x in rows[1:]:
                _, which, edges = places[x["kind"]]
                which = which[edges[x["part"]] : edges[x["part"] + 1]]
                if x["kind"] == WORD:
                    counts[which] = unpacked(x["found"], "<u4")
                else:
                    levels[which] = unpacked(x["found"], "u1")
            first = np.cumsum(length) - length  # each document has a token at least
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(np.frombuffer(r["ids"], "<i8"), mask=np.frombuffer(r["nulls"], bool)),
                "n_tokens": length, "n_known": np.add.reduceat((counts > 0)[back].astype(np.int64), first), "train_tokens": np.full(len(length), m.tokens, np.int64),
                "base_score": np.add.reduceat(np.log10(counts + 1.0)[back], first) - length * np.log10(m.tokens + m.types + 1.0),
                "score": np.add.reduceat(m.log10p(counts, back, _STANDS_FOR[levels][of]), first),
            })

    own = asked.filter(F.col("kind") == CHUNK_ROW)
    schema = RESULT.replace("held_out boolean, ", "")
    return own.unionByName(answered, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind", "part").mapInArrow(released(task), schema)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles goes from the disks when it ends, not when Spark collects it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def lm_scores(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """RESULT for every row of docs (doc_id, text); those not held out are learnt from."""
    spark = docs.sparkSession
    parts = parts or parts_for(docs, factor=2)
    with shuffles_dropped(spark):
        merged = written(merge(count(docs.filter(~held_out(F.col("doc_id"))), parts), parts), "counts")
        model = spark.sparkContext.broadcast(Model(merged, parts))
        asked = written(chunks(docs, model), "asked")
        answered = written(answers(asked, merged, parts), "answers")
    out = gather(asked, answered, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
