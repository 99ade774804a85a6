"""N-gram Jaccard join: a blocked product of the document by n-gram incidence.

Documents of equal n-gram sets are one class.  Pairs of classes that share too
little for their sizes are discarded by bounds before any product is taken:

1. An n-gram of no other document adds nothing to an overlap.  A document of n
   n-grams with n - ceil(t * n) + 1 of those cannot reach Jaccard t, so most
   documents end here.  What travels is compact: for a chunk of documents and
   a part of the hash range, sorted hash remainders and document numbers.
2. Among the rest, n-grams are ordered from rare to frequent.  Documents that
   reach t share one of their first n - ceil(t * n) + 1, and where in both
   orders it stands bounds what they can share at all.
3. In each group that shares such an n-gram, all are compared with the member
   that shares most; components follow from the links.  Only groups that are
   still apart have their remaining pairs compared.

The overlap counts are sparse products of blocks.  A block holds some sets as
columns and those that are to be compared with any of them as rows; what rows
and columns have in common is added up n-gram by n-gram, and pairs whose count
stays below the bound of their sizes are discarded.  Sets with many partners
are dealt over blocks by their number, so that a group which holds a third of
all rows is spread over tasks.

Defined results: null and empty texts have no n-grams, belong to no pair and
are components of their own.  A document of fewer words than n is one n-gram.
Rows that repeat a doc_id stay; the component then holds all rows of the id.
A null doc_id is smaller than any other.  No rows give no rows.  Other columns
are not read.  Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, drop, mix64, parts_for, released, settled, slices, stored, string_bytes, written
from tessera.llm.components import components

SLICE, CHUNK = 1 << 19, 1 << 20
#: Bits of a hash that travel in stage 1, besides those that choose the part.
SHORT = 30
#: Pairs of a block of the product, where one set has many partners and where many have few; rows and entries of the incidence that are multiplied at once.
BLOCK, FEW, ROWS, ENTRIES = 256, 16, 4096, 1 << 20
NULL_ID = -(1 << 63)

_K = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class NgramSets:
    """Sorted distinct n-gram hashes of each document of a column."""

    def __init__(self, n: int) -> None:
        self.n, self.words = n, Words()

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        data, offsets = string_bytes(column)
        for i, j in slices(offsets, SLICE):
            words, at = self.words(data[offsets[i] : offsets[j]], offsets[i : j + 1])
            with np.errstate(over="ignore"):
                m = max(0, len(words) - self.n + 1)
                grams = np.zeros(m, np.uint64)
                for k in range(self.n):
                    grams += words[k : k + m] * _K[k]
                grams = mix64(grams)
                for d in range(j - i):
                    a, b = at[d], at[d + 1]
                    if b - a >= self.n:
                        yield i + d, np.unique(grams[a : b - self.n + 1])
                    elif b > a:
                        yield i + d, mix64((words[a:b] * _K[self.n + b - a : self.n + 2 * (b - a)]).sum(keepdims=True) + np.uint64(b - a))
                    else:
                        yield i + d, np.zeros(0, np.uint64)


def class_of(grams: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix64(mix64(grams ^ np.uint64(0x51ED270B76A1C3F5)).sum(keepdims=True) + np.uint64(len(grams)))[0].astype(np.int64))


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first n-grams of a set of n have one that it shares with any set in reach."""
    return n - (percent * n + 99) // 100 + 1


def packed(keys: np.ndarray) -> bytes:
    """Sorted unsigned numbers as steps of so many bytes as most of them need, which the first byte names; the largest value carries over."""
    steps = np.diff(keys, prepend=np.zeros(1, keys.dtype)).astype(np.int64)
    # A step carries over once in seven or less: the room follows the numbers, however far apart they are.
    width = next((w for w in (2, 3) if not len(keys) or int(keys[-1]) // len(keys) < 1 << (8 * w - 1)), 4)
    most = (1 << 8 * width) - 1
    over, rest = np.divmod(steps, most)
    out = np.full(int(over.sum()) + len(keys), most, "<u4")
    out[np.cumsum(over + 1) - 1] = rest
    return bytes([width]) + out.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 4), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    steps = steps.view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64)[steps < (1 << 8 * width) - 1]


SHAPES = "role int, part int, chunk long, keys binary, docs binary, ids binary, sizes binary, classes binary"


def shapes(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """Role 0: a chunk's documents, sizes and classes; role 1: its n-grams of one part."""
    names = [x.split()[0] for x in SHAPES.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, chunk = NgramSets(n), TaskContext.get().partitionId() << 32
        ids, grams, size = [], [], 0

        def rows() -> pa.RecordBatch:
            count = np.array([len(g) for g in grams], "<i8")
            every = np.concatenate(grams)
            doc = np.repeat(np.arange(len(grams), dtype="<u2"), count)
            part, key = (every >> np.uint64(SHORT)) % np.uint64(parts), every & np.uint64((1 << SHORT) - 1)
            order = np.argsort((part << np.uint64(SHORT)) | key)
            key, doc, edges = key[order], doc[order], np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            out = [[0, -1, chunk, None, None, np.array(ids, "<i8").tobytes(), count.tobytes(), np.array([class_of(g) for g in grams], "<i8").tobytes()]]
            for p in np.flatnonzero(np.diff(edges)):
                a, b = edges[p], edges[p + 1]
                out.append([1, int(p), chunk, packed(key[a:b]), doc[a:b].tobytes(), None, None, None])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            named = batch.column("doc_id").to_numpy()
            for i, g in sets.of(batch.column("text")):
                ids.append(named[i])
                grams.append(g)
                size += len(g)
                if size >= CHUNK or len(ids) == 65535:
                    yield rows()
                    chunk += 1
                    ids, grams, size = [], [], 0
        if ids:
            yield rows()

    return docs.mapInArrow(released(task), SHAPES)


def lonely(shaped: DataFrame, parts: int) -> DataFrame:
    """chunk, docs, counts: how many of a document's n-grams of a part no other document has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[dict]) -> pa.RecordBatch:
            keys = [unpacked(r["keys"]) for r in held]
            every = np.sort(np.concatenate(keys))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            out = {"chunk": pa.array([r["chunk"] for r in held], pa.int64()), "docs": [], "counts": []}
            for r, k in zip(held, keys, strict=True):
                alone = np.ones(len(k), bool) if not len(twice) else twice[np.searchsorted(twice, k).clip(max=len(twice) - 1)] != k
                docs, counts = np.unique(np.frombuffer(r["docs"], "<u2")[alone], return_counts=True)
                out["docs"].append(docs.astype("<u2").tobytes())
                out["counts"].append(counts.astype("<u4").tobytes())
            return pa.RecordBatch.from_pydict(out)

        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now and held:
                    yield rows(held)
                    held = []
                now = r["part"]
                held.append(r)
        if held:
            yield rows(held)

    asked = shaped.filter("role = 1").select("part", "chunk", "keys", "docs")
    return asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(released(task), "chunk long, docs binary, counts binary")


def members(shaped: DataFrame, alone: DataFrame, percent: int) -> DataFrame:
    """doc_id, size, class, near: every document, and whether it can be near any other."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(own: dict, counts: np.ndarray) -> pa.RecordBatch:
            size = np.frombuffer(own["sizes"], "<i8")
            near = (size > 0) & (counts < prefix(size, percent))
            return pa.RecordBatch.from_pydict({"doc_id": np.frombuffer(own["ids"], "<i8"), "size": size, "class": np.frombuffer(own["classes"], "<i8"), "near": near})

        own, counts = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["role"] == 0:
                    if own:
                        yield rows(own, counts)
                    own, counts = r, np.zeros(len(r["ids"]) // 8, np.int64)
                else:
                    counts[np.frombuffer(r["docs"], "<u2")] += np.frombuffer(r["counts"], "<u4")
        if own:
            yield rows(own, counts)

    rows = shaped.filter("role = 0").select("role", "chunk", "ids", "sizes", "classes")
    rows = rows.unionByName(alone.withColumn("role", F.lit(1)), allowMissingColumns=True)
    return rows.repartition("chunk").sortWithinPartitions("chunk", "role").mapInArrow(released(task), "doc_id long, size long, class long, near boolean")


def class_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, size, grams: the n-grams of each class of wanted (doc_id, class), from a document of it.

    A class comes twice where its document does; that adds work and no links.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = NgramSets(n)
        for batch in batches:
            asked, out = batch.column("class").to_numpy(), {"class": [], "size": [], "grams": []}
            for i, g in sets.of(batch.column("text")):
                if class_of(g) == asked[i]:
                    out["class"].append(asked[i])
                    out["size"].append(len(g))
                    out["grams"].append(g.astype("<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"class": pa.array(out["class"], pa.int64()), "size": pa.array(out["size"], pa.int64()), "grams": pa.array(out["grams"], pa.binary())})

    return docs.join(wanted.withColumnsRenamed({"doc_id": "of_doc"}), F.col("doc_id") == F.col("of_doc")).select("class", "text").mapInArrow(released(task), "class long, size long, grams binary")


def few(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of at most SLICE bytes of a binary column, or one row."""
    for i, j in slices(string_bytes(batch.column(column))[1], SLICE):
        yield batch.slice(i, j - i)


def incidence(sets: DataFrame, percent: int) -> DataFrame:
    """gram, class, size, place: the first n-grams of each class from rare to frequent, of those that two classes have."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in few(batch, "grams"):
                grams = [np.frombuffer(g.as_buffer(), "<i8") for g in some.column("grams")]
                name = np.repeat(some.column("class").to_numpy(), [len(g) for g in grams])
                yield pa.RecordBatch.from_pydict({"gram": np.concatenate(grams), "class": name})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Numbers stay in their buffers: as lists of Python's they take five times the room, and a batch has 10 000 sets.
            for some in few(batch, "grams"):
                out = {"gram": [], "class": [], "size": [], "place": []}
                for name, grams, shared, times in zip(*(some.column(c) for c in ("class", "grams", "shared", "times")), strict=True):
                    size = len(grams.as_buffer()) // 8
                    known, at = np.unique(shared.values.to_numpy(), return_index=True)
                    lone = size - len(known)
                    keep = int(prefix(np.int64(size), percent)) - lone
                    if keep > 0:
                        g = known[np.lexsort((known, times.values.to_numpy()[at]))][:keep]
                        for c, x in zip(out, (g, np.full(len(g), name.as_py(), np.int64), np.full(len(g), size, np.int64), lone + np.arange(len(g))), strict=True):
                            out[c].append(x)
                if out["gram"]:
                    yield pa.RecordBatch.from_pydict({c: np.concatenate(x) for c, x in out.items()})

    spread_out = sets.select("class", "grams").mapInArrow(released(spread), "gram long, class long")
    counted = written(spread_out.groupBy("gram").agg(F.count("*").alias("times")).filter("times > 1"), "shared")
    shared = spread_out.join(counted, "gram")
    # A class has as many rows as its one document has n-grams.
    listed = shared.groupBy("class").agg(F.collect_list("gram").alias("shared"), F.collect_list("times").alias("times"))
    return sets.join(listed, "class").mapInArrow(released(first), "gram long, class long, size long, place long")


def _reach(a: str, b: str, percent: int):
    """Whether sizes and places allow an overlap that reaches the threshold."""
    need = F.ceil((F.col(f"{a}_size") + F.col(f"{b}_size")) * percent / (100 + percent) - 1e-9)
    return 1 + F.least(F.col(f"{a}_size") - F.col(f"{a}_place"), F.col(f"{b}_size") - F.col(f"{b}_place")) - 1 >= need


class Columns:
    """The columns of a block: an incidence matrix, n-gram by n-gram."""

    def __init__(self, names: list[int], sets: list[np.ndarray]) -> None:
        self.names, self.sizes = np.array(names, np.int64), np.array([len(x) for x in sets], np.int64)
        gram = np.concatenate(sets)
        order = np.argsort(gram, kind="stable")
        self.gram, self.column = gram[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def times(self, rows: list[np.ndarray]) -> np.ndarray:
        """(rows, columns): how many n-grams each row shares with each column."""
        sizes = np.array([len(x) for x in rows])
        gram, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        low = np.searchsorted(self.gram, gram, side="left")
        many = np.searchsorted(self.gram, gram, side="right") - low
        low, many, row = low[many > 0], many[many > 0], row[many > 0]
        shape = len(rows), len(self.names)
        counts = np.zeros(shape[0] * shape[1], np.int64)
        upto = np.cumsum(many)
        at = 0
        while at < len(many):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ENTRIES, side="right")))
            n = many[at:stop]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = self.column[np.repeat(low[at:stop], n) + inside]
            counts += np.bincount(np.repeat(row[at:stop], n) * shape[1] + hit, minlength=len(counts))
            at = stop
        return counts.reshape(shape)

    def linked(self, rows: list[np.ndarray], asked: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, name of the column, overlap) of the pairs that are asked for, by the columns' names for each row, and reach the threshold."""
        overlap = self.times(rows)
        size = np.array([len(x) for x in rows], np.int64)
        order = np.argsort(self.names, kind="stable")
        row = np.repeat(np.arange(len(rows)), [len(a) for a in asked])
        column = order[np.searchsorted(self.names[order], np.concatenate(asked))]
        found = overlap[row, column]
        good = 100 * found >= percent * (size[row] + self.sizes[column] - found)
        return row[good], self.names[column[good]], found[good]


def products(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, rows) that reach the threshold: src, dst, overlap.

    `rows` says how many x a y may have; it sets the number of y's blocks.
    Sets y of few x share blocks.
    """
    pairs = written(pairs.select("x", "y", "rows"), "pairs")
    shared = max(1, pairs.filter(F.col("rows") < BLOCK).count() // FEW)
    salt = F.pmod(F.xxhash64("x"), F.ceil(F.col("rows") / BLOCK))
    block = F.when(F.col("rows") < BLOCK, F.pmod(F.xxhash64("y"), F.lit(shared))).otherwise(F.xxhash64("y", salt))
    blocks = pairs.select("x", "y", block.alias("block"))
    column = blocks.select(F.col("y").alias("class"), "block").distinct().select("class", "block", F.lit(0).alias("role"), F.array().cast("array<long>").alias("asked"))
    # No set asks for more columns than its block has.
    row = blocks.groupBy(F.col("x").alias("class"), "block").agg(F.collect_set("y").alias("asked")).select("class", "block", F.lit(1).alias("role"), "asked")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, held, wanted, columns, size = None, [], [], [], None, 0

        def links() -> pa.RecordBatch:
            i, dst, overlap = columns.linked(held, wanted, percent)
            return pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[i], pa.int64()), pa.array(dst, pa.int64()), pa.array(overlap, pa.int64())], ["src", "dst", "overlap"])

        for batch in batches:
            block, role, name = (batch.column(k).to_numpy() for k in ("block", "role", "class"))
            grams, asked = batch.column("grams"), batch.column("asked")
            for i in range(batch.num_rows):
                key = block[i], role[i]
                if key != now or role[i] == 1 and (size >= ENTRIES or len(held) >= ROWS):
                    if now and now[1] == 0:
                        columns = Columns(names, held)
                    elif now:
                        yield links()
                    now, names, held, wanted, size = key, [], [], [], 0
                names.append(name[i])
                held.append(np.frombuffer(grams[i].as_buffer(), "<u8").copy())
                wanted.append(asked[i].values.to_numpy())
                size += len(held[-1])
        if now:  # a block ends in rows
            yield links()

    laid = column.unionByName(row).join(sets.select("class", "grams"), "class").select("block", "role", "class", "asked", "grams")
    return laid.repartition("block").sortWithinPartitions("block", "role").mapInArrow(released(task), "src long, dst long, overlap long")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """src, dst: links between classes, enough of them to connect each component."""
    rows = written(incidence(sets, percent), "incidence")
    degree = rows.groupBy("gram").agg(F.count("*").alias("rows"), F.max("class").alias("a"), F.min("class").alias("b")).filter("a > b").select("gram", "rows")
    degree = written(degree, "groups")
    rows = rows.join(degree, "gram")
    weight = rows.groupBy("class").agg(F.sum("rows").alias("weight"))
    rows = written(rows.join(weight, "class"), "grouped")
    most = rows.groupBy("gram").agg(F.max(F.struct("weight", "class", "size", "place")).alias("y"))
    most = written(most.select("gram", F.col("y.class").alias("y"), F.col("y.size").alias("y_size"), F.col("y.place").alias("y_place")), "middles")
    with_middle = rows.select("gram", "rows", F.col("class").alias("x"), F.col("size").alias("x_size"), F.col("place").alias("x_place")).join(most, "gram")
    star = with_middle.filter((F.col("x") != F.col("y")) & _reach("x", "y", percent)).groupBy("x", "y").agg(F.max("rows").alias("rows"))
    star = written(star, "star")
    found = written(products(star, sets, percent).select("src", "dst"), "links")
    # Groups that are still apart: their smaller sides meet the others.
    label = written(components(found), "labels")
    labelled = written(rows.join(label.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class")), "labelled")
    sides = labelled.groupBy("gram", "label").agg(F.count("*").alias("side"))
    apart = sides.groupBy("gram").agg(F.max(F.struct("side", "label")).alias("large"), F.count("*").alias("sides"), F.sum("side").alias("all")).filter("sides > 1 and all > 2")
    apart = written(apart.select("gram", F.col("large.label").alias("large")), "apart")
    open_ = labelled.join(apart, "gram")
    small = open_.filter("label != large").select("gram", *[F.col(c).alias(f"y_{c}") for c in ("class", "size", "place", "label")])
    other = open_.select("gram", "rows", "large", *[F.col(c).alias(f"x_{c}") for c in ("class", "size", "place", "label")])
    # Of two small sides each pair is taken once.
    once = (F.col("x_label") == F.col("large")) | (F.col("x_class") < F.col("y_class"))
    rest = other.join(small, "gram").filter((F.col("x_label") != F.col("y_label")) & once & _reach("x", "y", percent))
    rest = rest.select(F.col("x_class").alias("x"), F.col("y_class").alias("y"), "rows").groupBy("x", "y").agg(F.max("rows").alias("rows"))
    more = products(rest.join(star.select("x", "y"), ["x", "y"], "left_anti"), sets, percent)
    return written(found.unionByName(more.select("src", "dst")), "alllinks")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, parts: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    parts = parts or parts_for(docs)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    shaped, path = stored(shapes(docs, n, parts), "shapes")
    every = written(members(shaped, lonely(shaped, parts), percent), "members")
    drop(spark, path)  # it is about as large as the texts, and all of it is read
    own, _ = settled(lambda: _named(docs, every, n, percent), "named")
    back = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return every.join(own, "class", "left").select(back("doc_id").alias("doc_id"), F.col("size").alias("n_shingles"), F.nullif(F.coalesce("component_id", "doc_id"), F.lit(NULL_ID)).alias("component_id"), F.col("class").alias("class_id"))


def _named(docs: DataFrame, every: DataFrame, n: int, percent: int) -> DataFrame:
    """class, component_id of the classes with n-grams."""
    classes = every.filter("near").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    sets = written(class_sets(docs, classes.select("doc_id", "class"), n), "sets")
    label = components(links(sets, percent))
    # A class without links is its own component; an empty set holds nobody together.
    own = every.filter("size > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    own = own.join(label.withColumnsRenamed({"node": "class"}), "class", "left").withColumn("label", F.coalesce("label", "class"))
    own = written(own, "classes")
    least = own.groupBy("label").agg(F.min("first").alias("component_id"))
    return own.join(least, "label").select("class", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: that of the smallest doc_id."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        dropped = jaccard_components(docs, **options).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
        return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)
    # Where ids are repeated the rows have numbers in their place; of rows that share the smallest doc_id the first stays.
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("__row"), "component_id")
    ones = found.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("one"))
    return rows.join(ones.select("one.__row"), "__row", "left_semi").select(*docs.columns)
