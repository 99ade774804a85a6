"""A stored index of vectors: coarse cells, codes of what is left in them, and the vectors for the last step.

Vectors are scaled to length one.  A cell is the nearest of a few centres; a
row's code is its residual in steps of 1/127 of its largest part, a byte each,
with the length of what the code leaves out.  A code so bounds the cosine from
both sides: a search scores codes of the cells that it visits, keeps the rows
whose upper bound reaches the k-th best lower bound, and reads and scores only
their vectors.  Over the visited cells the result is exact; with `exact` a
search visits them all.

Codes lie in the order of cells with the columns that filters use, so that cells
and filters are both pushed down to the scan.  Questions are a table too: they
are dealt over shares of QUESTIONS, and the codes, in packed blocks of ROWS, pass
by the questions of a share, which are not copied for the cells that they visit;
a task keeps for each of its questions the best bound that it has seen.

Centres are fitted to at most SAMPLE rows, chosen by hash, and so is the number
of cells that a question visits (recall of RECALL within the sample).  Vectors
that are null, zero, of another length or not finite take no part.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.plans.filters import And, Layout, Node, compile_filter
from tessera.sources.shared import exists, publish_text, read_text

#: Rows that centres and visits are fitted to, questions among them, and the recall within them.
SAMPLE, ASKED, RECALL = 1 << 14, 256, 0.97
#: Rows that a cell holds about, and cells at most (their centres go to every task).
PER_CELL, MOST_CELLS = 1 << 10, 1 << 13
#: Codes of a block, questions of a share about, and of those that meet a block at once; blocks that pass by in one task about.
ROWS, QUESTIONS, AT_ONCE, BLOCKS = 1 << 12, 1 << 11, 256, 256

PACKED = "role int, cells binary, ids binary, codes binary, scales binary, errors binary"
HIT = "question long, key long, cell int, low double, high double"


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-300)


def usable(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector has a direction."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good if dims is None else good & (F.size(vector) == dims), F.lit(False))


def centres_of(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors; the first centres are spread over the sample."""
    draw = np.random.default_rng(7)
    centres = sample[draw.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        empty = ~np.bincount(near, minlength=len(centres)).astype(bool)
        sums[empty] = sample[draw.choice(len(sample), int(empty.sum()))]
        centres = unit(sums)
    return centres


def visits(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many of its nearest cells a question has to visit for RECALL, by questions of the sample."""
    asked = sample[: min(ASKED, len(sample))]
    near = asked @ sample.T
    np.put_along_axis(near, np.arange(len(asked))[:, None], -np.inf, axis=1)
    best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    if not best.size:
        return len(centres)
    order = np.argsort(-(asked @ centres.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    cell = (sample @ centres.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(rank, cell[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        raw = json.loads(read_text(spark, f"{path}/centres.json"))
        self.centres = np.array(raw["centres"], np.float64)
        self.visits, self.dims = raw["visits"], self.centres.shape[1]

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "id", vector: str = "embedding", filters: tuple[str, ...] = (), k: int = 40, per_cell: int = PER_CELL) -> VectorIndex:
        """The index of rows (key, vector and columns that filters use), stored at a new path."""
        spark = rows.sparkSession
        good = rows.filter(usable(F.col(vector)))
        n = good.count()
        # Bounded: SAMPLE rows at most, or about as many by their hashes.
        share = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 0.95 * SAMPLE / max(n, 1)))
        some = good.filter(share).select(F.col(vector).cast("array<double>").alias("v")).limit(SAMPLE).collect()
        sizes = Counter(len(r["v"]) for r in some)
        dims = sizes.most_common(1)[0][0] if sizes else 1
        sample = unit(np.array([r["v"] for r in some if len(r["v"]) == dims], np.float64).reshape(-1, dims))
        cells = int(max(1, min(MOST_CELLS, len(sample), n // per_cell)))
        centres = centres_of(sample, cells) if len(sample) else np.zeros((1, dims))
        meta = {"centres": centres.tolist(), "visits": visits(sample, centres, k) if len(sample) else 1}
        publish_text(spark, f"{path}/centres.json", json.dumps(meta))
        index = cls(spark, path)
        index.append(rows, key, vector, filters)
        return index

    @classmethod
    def stored(cls, rows: DataFrame, path: str, **how) -> VectorIndex:
        return cls(rows.sparkSession, path) if exists(rows.sparkSession, f"{path}/codes/_SUCCESS") else cls.build(rows, path, **how)

    def append(self, rows: DataFrame, key: str = "id", vector: str = "embedding", filters: tuple[str, ...] = ()) -> None:
        """More rows under the same centres."""
        centres, schema = self.centres, "cell int, code binary, scale float, error float"
        given = rows.filter(usable(F.col(vector), self.dims)).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), *filters)
        arrow = [("cell", pa.int32()), ("code", pa.binary()), ("scale", pa.float32()), ("error", pa.float32())]

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(_matrix(batch.column("vector")))
                cell = (x @ centres.T).argmax(axis=1)
                left = x - centres[cell]
                scale = np.maximum(np.abs(left).max(axis=1), 1e-30).astype(np.float32)
                code = np.clip(np.rint(left / scale[:, None].astype(np.float64) * 127), -127, 127).astype(np.int8)
                # Rounded up: a bound stays a bound.
                error = np.sqrt(((left - code * (scale[:, None].astype(np.float64) / 127)) ** 2).sum(axis=1)) * 1.0001 + 1e-9
                new = [pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error.astype(np.float32) * np.float32(1.0001))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(n for n, _ in arrow)])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
        rows = given.mapInArrow(coded, f"{fields}, {schema}").repartitionByRange("cell", "key").sortWithinPartitions("cell", "key")
        rows.write.mode("append").parquet(f"{self.path}/codes")

    def rows(self) -> DataFrame:
        """key, vector, cell, code, scale, error and the columns of filters."""
        return self.spark.read.parquet(f"{self.path}/codes")

    def knn_many(self, questions: DataFrame, k: int = 40, *, key: str = "id", vector: str = "embedding", where: Node = And(), layout: Layout | None = None, exact: bool = False, itself: bool = False, cells: int | None = None) -> DataFrame:
        """question, key, similarity, rank, scored: the k nearest rows of every question (key, vector) among those that a filter lets through.

        `scored` counts the vectors read for the question.  With `itself` a row
        that has the question's key counts too.
        """
        asked = questions.filter(usable(F.col(vector), self.dims)).select(F.col(key).cast("long").alias("question"), F.col(vector).cast("array<double>").alias("asked"))
        kept = self.rows().filter(compile_filter(where, layout))
        most = len(self.centres) if exact else min(len(self.centres), cells or self.visits)
        hits = self._dealt(kept, asked).mapInArrow(self._scored(k, most, itself), HIT)
        # The k-th best lower bound of all tasks.
        low = Window.partitionBy("question").orderBy(F.col("low").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        least = F.nth_value("low", k).over(low)
        good = hits.withColumn("least", least).filter(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("question", "key", "cell")
        exactly = good.join(kept.select("cell", "key", "vector"), ["cell", "key"]).join(asked, "question")
        scored = exactly.select("question", "key", cosine("vector", F.col("asked")).alias("similarity"))
        best = Window.partitionBy("question").orderBy(F.col("similarity").desc(), "key")
        ranked = scored.withColumns({"rank": F.row_number().over(best), "scored": F.count("*").over(Window.partitionBy("question"))})
        return ranked.filter(F.col("rank") <= k)

    def knn(self, query: list[float], k: int = 40, *, where: Node = And(), layout: Layout | None = None, exact: bool = False) -> DataFrame:
        """key, similarity of the k nearest rows for one question."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "id long, embedding array<double>")
        return self.knn_many(asked, k, where=where, layout=layout, exact=exact, itself=True).select("key", "similarity")

    def _dealt(self, kept: DataFrame, asked: DataFrame) -> DataFrame:
        """Packed questions (role 0) and blocks of codes (role 1) by the part in which they meet: a share of the questions and a group of the blocks."""
        dims = self.dims
        shares = asked.count() // QUESTIONS + 1
        slots = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        groups = max(1, slots // shares, self.rows().count() // (ROWS * BLOCKS))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    columns = [some.column(c).to_numpy(zero_copy_only=False).astype(t).tobytes() for c, t in (("cell", np.int32), ("key", np.int64), ("scale", np.float32), ("error", np.float32))]
                    yield _packed(1, columns[0], columns[1], b"".join(some.column("code").to_pylist()), columns[2], columns[3])

        def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                share = batch.column("share").to_numpy(zero_copy_only=False)
                vectors = np.ascontiguousarray(unit(_matrix(batch.column("asked")).reshape(-1, dims)))
                names = batch.column("question").to_numpy(zero_copy_only=False).astype(np.int64)
                for one in np.unique(share):
                    packed = _packed(0, None, names[share == one].tobytes(), vectors[share == one].tobytes(), None, None)
                    yield pa.RecordBatch.from_arrays([*packed.columns, pa.array([int(one)], pa.int32())], [*packed.schema.names, "share"])

        share = F.pmod(F.xxhash64("question"), F.lit(shares)).cast("int").alias("share")
        left = asked.select("question", "asked", share).mapInArrow(questions, f"{PACKED}, share int").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = kept.select("cell", "key", "code", "scale", "error").mapInArrow(blocks, PACKED)
        right = right.withColumns({"group": F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"), "share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))})
        both = left.unionByName(right).withColumn("part", F.col("share") * groups + F.col("group"))
        return both.repartition(max(1, min(shares * groups, 4 * slots)), "part").sortWithinPartitions("part", "role").select("part", *[c.split()[0] for c in PACKED.split(", ")])

    def _scored(self, k: int, most: int, itself: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """HIT rows: what the codes of the visited cells leave possible."""
        centres, dims = self.centres, self.dims

        def visiting(q: np.ndarray) -> np.ndarray | None:
            """(questions, cells): whether a question visits a cell; none where all visit all."""
            if most >= len(centres):
                return None
            visits = np.zeros((len(q), len(centres)), bool)
            for at in range(0, len(q), AT_ONCE):
                near = q[at : at + AT_ONCE] @ centres.T
                np.put_along_axis(visits[at : at + AT_ONCE], np.argsort(-near, axis=1, kind="stable")[:, :most], True, axis=1)
            return visits

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, names, q, visits, bound = None, [], [], None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    part, role = batch.column("part")[i].as_py(), batch.column("role")[i].as_py()
                    one = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: E731, B023
                    if part != now:
                        now, names, q, bound = part, [], [], None
                    if role == 0:
                        names.append(one("ids", np.int64).copy())
                        q.append(one("codes", np.float64).reshape(-1, dims).copy())
                        continue
                    if not names:
                        continue
                    if bound is None:
                        named, vectors = np.concatenate(names), np.concatenate(q)
                        visits, bound = visiting(vectors), np.full(len(named), -np.inf)
                    cells, ids, scales, errors = one("cells", np.int32), one("ids", np.int64), one("scales", np.float32).astype(np.float64), one("errors", np.float32).astype(np.float64)
                    rows = centres[cells] + one("codes", np.int8).reshape(-1, dims) * (scales / 127)[:, None]
                    # All rows of the block, or those of one cell after another with the questions that visit it.
                    runs = [np.arange(len(cells))] if visits is None else np.split(np.arange(len(cells)), np.flatnonzero(np.diff(cells)) + 1)
                    hits: list[tuple[np.ndarray, ...]] = []
                    for run in runs:
                        come = np.arange(len(named)) if visits is None else np.flatnonzero(visits[:, cells[run[0]]])
                        for at in range(0, len(come), AT_ONCE):
                            who = come[at : at + AT_ONCE]
                            near = vectors[who] @ rows[run].T
                            if not itself:
                                near[named[who][:, None] == ids[run]] = -np.inf
                            low = near - (errors[run] + 1e-12)
                            if low.shape[1] > k:
                                bound[who] = np.maximum(bound[who], np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
                            a, b = np.nonzero((near + (errors[run] + 1e-12) >= bound[who][:, None]) & (near > -np.inf))
                            hits.append((named[who[a]], ids[run[b]], cells[run[b]], low[a, b], near[a, b] + errors[run[b]] + 1e-12))
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*hits, strict=True)], ["question", "key", "cell", "low", "high"])

        return task


def _packed(role: int, *columns: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([role], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]], [c.split()[0] for c in PACKED.split(", ")])


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
