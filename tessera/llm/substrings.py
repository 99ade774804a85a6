"""Suffix-array dedup: removes every byte of a long string that occurs again.

A string of SPAN bytes is repeated when it also starts anywhere else.  Sorting
all suffixes would put repeated strings side by side; here only those are
sorted that can be repeated:

1. Every window of SPAN bytes has an anchor, the GRAM bytes in it of least
   hash.  Equal windows have equal anchors at equal places.  An anchor and
   the run of windows that it stands for are one context.
2. Anchors that occur once fall away.  Equal contexts collapse to one with a
   count before they shuffle; a context that occurs again is wholly repeated.
3. Contexts that share an anchor but differ are sorted twice, by what follows
   the anchor and by what precedes it, with hash comparisons.  Windows at
   distance d before the anchor are equal when their contexts share SPAN - d
   bytes forwards and d bytes backwards, which the common lengths of sorted
   neighbours tell.
4. An anchor with too many contexts for one task is split: its windows are
   halved, and each half gets a longer anchor.  Repeated to the end, that
   leaves single windows, which only have to be counted.

That is done twice: with a span of PASSAGE bytes over all texts, which finds
passages too short to be removed, and with SPAN over the stretches that this
leaves.  A string of SPAN bytes that occurs again lies in such a stretch in
each of its places, so none is lost.

Defined results: texts are UTF-8 bytes; null and empty texts have none.
Matches never cross documents; a text under SPAN bytes loses nothing.  A
stretch of repeated strings of PASSAGE bytes is a passage when it has WORDS
words or more; passages are counted and stay.  Rows that repeat doc_id and
text are copies of each other like any rows.  No rows give no rows.  Other
columns are not read.  Very long texts are cut into pieces that share one byte
less than the span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, mix64, released, settled, stored, string_bytes, written
from tessera.llm.suffix_sort import BASES, Polynomial, sort_suffixes

SPAN, GRAM = 400, 128
#: A passage has more than 50 words; with four letters and a blank each, they have so many bytes.
WORDS, PASSAGE, PASSAGE_GRAM = 51, 256, 64
#: Windows of a piece and bytes of a slice; a slice's places fit in PLACE bits.
PIECE, SLICE, PLACE = 1 << 19, 1 << 20, 22
#: Contexts of one anchor that a task sorts, and bytes that it sorts at once.
MOST, SORT = 4096, 1 << 22
#: Names of contexts that are broadcast, 16 bytes each; more meet their rows by a join that is split where it is skewed.
FEW = 1 << 16

CONTEXTS = "key long, digest long, rid long, start long, width int, lead int"


def row_id() -> F.Column:
    """Names a row by its content; rows alike in doc_id and text have one name and one result."""
    return F.xxhash64("doc_id", "text")


def digest_of(data: memoryview | bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint64).view(np.int64)


class Anchors:
    """Contexts of documents: which anchor, which run of windows."""

    def __init__(self, span: int, gram: int, piece: int = PIECE, most: int = SLICE) -> None:
        self.span, self.gram, self.piece, self.most, self.hash = span, gram, piece, most, Polynomial(BASES[0])

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """(row, place in its text, bytes), some at a time."""
        held, size = [], 0
        for row in np.flatnonzero(np.diff(offsets) >= self.span):
            text = data[offsets[row] : offsets[row + 1]]
            for at in range(0, len(text) - self.span + 1, self.piece):
                piece = text[at : at + self.piece + self.span - 1]
                held.append((row, at, piece))
                size += len(piece)
                if size >= self.most:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def of(self, pieces: list[tuple[int, int, np.ndarray]], named: bool = True) -> dict[str, np.ndarray]:
        """The contexts of some pieces; without names, their anchors alone."""
        data = np.concatenate([p for *_, p in pieces])
        size = np.array([len(p) for *_, p in pieces])
        ends = np.cumsum(size)
        begins = ends - size
        grams = len(data) - self.gram + 1
        keys = mix64(self.hash.of(self.hash.prefixes(data), np.arange(grams), self.gram))
        # The least hash of each run of w, by block-wise running minima from both sides.
        w = self.span - self.gram + 1
        ranked = (keys >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(grams, dtype=np.uint64)
        rows = -(-(grams + w) // w)
        padded = np.full(rows * w, np.iinfo(np.uint64).max)
        padded[:grams] = ranked
        ahead = np.minimum.accumulate(padded.reshape(rows, w), axis=1).ravel()
        behind = np.minimum.accumulate(padded.reshape(rows, w)[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = size - self.span + 1
        start = np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        anchor = (np.minimum(behind[start], ahead[start + w - 1]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
        width = np.diff(np.append(new, len(start)))
        a, p = start[new], anchor[new]
        if not named:
            return {"key": _signed(keys[p])}
        piece = np.searchsorted(ends, a, side="right")
        view = memoryview(data)
        digests = np.fromiter((digest_of(view[x : x + y]) for x, y in zip(a.tolist(), (width + self.span - 1).tolist(), strict=True)), np.int64, len(a))
        row = np.array([r for r, *_ in pieces])[piece]
        at = np.array([s for _, s, _ in pieces])[piece]
        return {"key": _signed(keys[p]), "digest": digests, "row": row, "start": a - begins[piece] + at, "width": width, "lead": p - a}


def contexts(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """CONTEXTS of docs (rid, at, text): texts, or stretches of them that begin at `at`."""
    sizes = PIECE, SLICE

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(span, gram, *sizes)
        for batch in batches:
            rid, place = batch.column("rid").to_numpy(), batch.column("at").to_numpy()
            for pieces in anchors.pieces(*string_bytes(batch.column("text"))):
                found = anchors.of(pieces)
                yield pa.RecordBatch.from_arrays([pa.array(found["key"]), pa.array(found["digest"]), pa.array(rid[found["row"]]), pa.array(found["start"] + place[found["row"]], pa.int64()), pa.array(found["width"], pa.int32()), pa.array(found["lead"], pa.int32())], ["key", "digest", "rid", "start", "width", "lead"])

    return docs.mapInArrow(released(task), CONTEXTS)


def anchors_of(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """The key of every context of docs (rid, at, text)."""
    sizes = PIECE, SLICE

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(span, gram, *sizes)
        for batch in batches:
            for pieces in anchors.pieces(*string_bytes(batch.column("text"))):
                yield pa.RecordBatch.from_pydict(anchors.of(pieces, named=False))

    return docs.select("text").mapInArrow(released(task), "key long")


OPEN = f"{CONTEXTS}, n long, hot boolean"


def settle(rows: DataFrame, keys: DataFrame, span: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(spans of wholly repeated contexts, contexts still open with count n and hot), from all contexts and the keys of all.

    Of contexts that occur again one stays open, for others to be compared
    with, where its anchor has other contexts too.
    """
    extra = [c for c in rows.columns if c not in CONTEXTS.replace(",", "").split()]
    again = written(keys.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "again")
    rows = written(rows.join(again, "key"), "contexts")
    alike = rows.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("rid", "start", "width", "lead", *extra)).alias("one"))
    alike = written(alike, "alike")
    found = []
    # Contexts that very many rows hold are few; while they are, their rows need no shuffle.
    many = alike.filter(F.col("n") > most).select("key", "digest")
    if 0 < many.limit(FEW + 1).count() <= FEW:
        found.append(rows.join(F.broadcast(many), ["key", "digest"]))
        rows = rows.join(F.broadcast(many), ["key", "digest"], "left_anti")
    found.append(rows.join(alike.filter("n > 1").select("key", "digest"), ["key", "digest"]))
    done = reduce(DataFrame.unionByName, [f.select("rid", F.col("start").alias("from"), (F.col("start") + F.col("width") + (span - 1)).alias("to")) for f in found])
    several = alike.groupBy("key").agg(F.count("*").alias("several")).filter("several > 1").select("key", (F.col("several") > most).alias("hot"))
    open_ = alike.join(written(several, "several"), "key").select("key", "digest", "one.*", "n", "hot")
    return done, written(open_.select("key", "digest", "rid", "start", "width", "lead", *extra, "n", "hot"), "open")


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(row, entry) of every entry of a column of arrays of structs."""
    return pa.compute.list_parent_indices(lists).to_numpy().astype(np.int64), lists.flatten()


def with_bytes(open_: DataFrame, docs: DataFrame, span: int) -> DataFrame:
    """The open contexts with their bytes, from docs (rid, at, text)."""
    schema = f"{OPEN}, bytes binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            row, asked = _flat(batch.column("asked"))
            got = {k: asked.field(k) for k in ("key", "digest", "start", "width", "lead", "n", "hot")}
            start = got["start"].to_numpy()
            a = offsets[row] - batch.column("at").to_numpy()[row] + start
            b = a + got["width"].to_numpy() + (span - 1)
            inside = np.flatnonzero((offsets[row] <= a) & (b <= offsets[row + 1]))
            cut = [bytes(view[x:y]) for x, y in zip(a[inside].tolist(), b[inside].tolist(), strict=True)]
            here = pa.array(inside)
            columns = {k: v.take(here) for k, v in got.items()} | {"rid": batch.column("rid").take(pa.array(row[inside])), "bytes": pa.array(cut, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns[k] for k in names], names)

    # A text has no more contexts than windows.
    asked = open_.groupBy("rid").agg(F.collect_list(F.struct("key", "digest", "start", "width", "lead", "n", "hot")).alias("asked"))
    return docs.join(asked, "rid").mapInArrow(released(task), schema)


def halves(hot: DataFrame, span: int, step: int) -> DataFrame:
    """Contexts cut where the distance to the anchor passes a multiple of `step`.

    The new anchor is what all windows of the cell have in common, so equal
    windows stay together.
    """
    schema = f"{CONTEXTS}, bytes binary"
    names = [c.split()[0] for c in schema.split(", ")]
    types = (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.binary(),)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                far, near = r["lead"], r["lead"] - r["width"] + 1
                for low in range(near // step * step, far + 1, step):
                    top, end = min(far, low + step - 1), max(near, low)
                    skip, width = far - top, top - end + 1
                    piece = r["bytes"][skip : skip + width + span - 1]
                    core = r["bytes"][far - low : far - low - step + 1 + span]
                    out.append((digest_of(low.to_bytes(8, "little") + core), digest_of(piece), r["rid"], r["start"] + skip, width, top, piece))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return hot.mapInArrow(released(task), schema)


def _repeated(rows: list[dict], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, end of windows) for each run of repeated windows of sorted contexts."""
    lead, width = np.array([r["lead"] for r in rows]), np.array([r["width"] for r in rows])
    key, size = np.array([r["key"] for r in rows]), np.array([len(r["bytes"]) for r in rows])
    data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    at = np.cumsum(size) - size + lead
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    ahead, follows = sort_suffixes(data, at, size - lead, group)
    behind, precedes = sort_suffixes(np.ascontiguousarray(data[::-1]), len(data) - at, lead, group)
    found = np.zeros((len(rows), int(width.max()) + 2), np.int8)
    one, two = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for d in range(int((lead - width).min()) + 1, int(lead.max()) + 1):
        has = np.flatnonzero((d <= lead) & (d > lead - width))
        if len(has) < 2:
            continue
        one[ahead], two[behind] = np.cumsum(follows < span - d), np.cumsum(precedes < d)
        _, back, times = np.unique(one[has] * (len(rows) + 1) + two[has], return_inverse=True, return_counts=True)
        again = has[times[back] > 1]
        found[again, lead[again] - d + 1] = 1
    step = np.diff(found, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1]


def sorted_spans(open_: DataFrame, span: int) -> DataFrame:
    """rid, from, to: repeated stretches of contexts, by sorting those of an anchor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans() -> pa.RecordBatch:
            row, first, end = _repeated(held, span)
            rid, start = np.array([r["rid"] for r in held]), np.array([r["start"] for r in held])
            return pa.RecordBatch.from_pydict({"rid": rid[row], "from": start[row] + first, "to": start[row] + end + (span - 1)})

        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if size >= SORT and r["key"] != held[-1]["key"]:
                    yield spans()
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield spans()

    return open_.repartition("key").sortWithinPartitions("key").mapInArrow(released(task), "rid long, from long, to long")


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """rid, from, to of docs (rid, at, text): stretches that repeated strings cover; they may overlap."""
    done, open_ = settle(contexts(docs, span, gram), anchors_of(docs, span, gram), span, most)
    found, step = [done], 1 << (span - gram).bit_length()
    hot = open_.filter("hot").limit(1).count() > 0
    open_ = with_bytes(open_, docs, span)
    while hot:
        open_, step = written(open_, "bytes"), step >> 1
        found.append(sorted_spans(open_.filter("not hot"), span))
        half = halves(open_.filter("hot"), span, step)
        done, open_ = settle(half, half, span, most)
        found.append(done)
        hot = open_.filter("hot").limit(1).count() > 0
    found.append(sorted_spans(open_, span))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the unions of each row's spans, in order."""
    row, spans = _flat(lists)
    a, b = spans.field("from").to_numpy(), spans.field("to").to_numpy()
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    if not len(row):
        return row, a, b
    # Ends of later rows are larger than those of all before.
    far = int(b.max()) + 1
    reach = np.maximum.accumulate(row * far + b)
    new = np.append(True, row[1:] * far + a[1:] > reach[:-1]) | np.append(True, row[1:] != row[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], a[new], reach[last] - row[last] * far


def gathered(spans: DataFrame, name: str) -> DataFrame:
    """rid and its spans as an array; a text has no more spans than windows."""
    return spans.groupBy("rid").agg(F.collect_list(F.struct("from", "to")).alias(name))


def stretches(docs: DataFrame, near: DataFrame, span: int) -> DataFrame:
    """rid, at, text: what repeated passages cover of docs (rid, text), where it is `span` bytes or more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            row, a, b = merged(batch.column("near"))
            long = b - a >= span
            row, a, b = row[long], a[long], b[long]
            cut = [bytes(view[x:y]) for x, y in zip((offsets[row] + a).tolist(), (offsets[row] + b).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(row)), pa.array(a, pa.int64()), pa.array(cut, pa.binary())], ["rid", "at", "text"])

    return docs.join(near, "rid").select("rid", "text", "near").mapInArrow(released(task), "rid long, at long, text binary")


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, most: int = MOST, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, spans (from, to), kept (bytes), passages (from, to) for every row of docs (doc_id, text); `passage` is at most `span`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", row_id())
    whole = docs.select("rid", F.lit(0).cast("long").alias("at"), "text")
    near, _ = settled(lambda: gathered(repeated_spans(whole, passage, passage_gram, most), "near"), "near")
    long, path = stored(stretches(docs, near, span), "stretches")
    spans, _ = settled(lambda: gathered(repeated_spans(long, span, gram, most), "found"), "spans")
    drop(docs.sparkSession, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(row: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["from", "to"]))

        blank = np.zeros(256, bool)
        blank[[32, *range(9, 14)]] = True
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            view, n = memoryview(np.ascontiguousarray(data)), batch.num_rows
            row, a, b = merged(batch.column("found"))
            edges, kept = np.searchsorted(row, np.arange(n + 1)), []
            for i in range(n):
                own = slice(edges[i], edges[i + 1])
                cuts = [offsets[i], *(np.stack([a[own], b[own]], 1) + offsets[i]).ravel().tolist(), offsets[i + 1]]
                kept.append(b"".join(view[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
            near, x, y = merged(batch.column("near"))
            # Words that begin in a span, and the one that it cuts at its begin.
            inside = ~blank[data]
            begins = np.append(0, np.cumsum(inside & np.append(True, ~inside[:-1]))) if len(data) else np.zeros(1, np.int64)
            p, q = offsets[near] + x, offsets[near] + y
            cut = (p > 0) & inside[p] & inside[np.maximum(p - 1, 0)]
            long = begins[q] - begins[p] + cut >= words
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), listed(row, a, b, n), pa.array(kept, pa.binary()), listed(near[long], x[long], y[long], n)], ["doc_id", "n_bytes", "spans", "kept", "passages"])

    schema = "doc_id long, n_bytes long, spans array<struct<from: long, to: long>>, kept binary, passages array<struct<from: long, to: long>>"
    return docs.join(spans, "rid", "left").join(near, "rid", "left").select("doc_id", "text", "found", "near").mapInArrow(released(task), schema)


def digest(cleaned: DataFrame) -> DataFrame:
    size = F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return cleaned.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"), size.alias("n_passage_bytes"))
