"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a unit vector to a cell of a lattice: each Gaussian projection is
moved by an offset, divided by a width and rounded down, STEPS steps an axis of
which the outer ones are open.  Of each table a query visits its own cell and
then perturbed ones in the order of their estimated success, the squared
distance from the query's projections to the cell, until they hold a share of
all rows.  Only rows of visited cells are multiplied with the query; they are
ranked by exact cosine in double precision.

Offsets are the medians of a bounded sample, the width is that of WIDTHS with
which the fewest rows have to be visited, and the share is fitted as well: the
smallest that would find GOAL of the nearest rows within the sample.  Vectors with structure need little of the table,
vectors without any a large part.  Rows of the sample lie farther apart than
those of the table, which makes the share rather too large than too small.

The lattice is bounded, and so is the directory of its cells and their row
counts, which goes to all workers.  Cells are laid out in blocks of BLOCK rows;
a cell with more, such as one with a vector that a third of all rows share, is
dealt over several blocks.  Every row lies once in each table; a block's rows
are read first, and the queries that visit it pass by.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; neither do null ids.  A row
is never its own neighbour: rows of the query's id are left out, and repeated
ids count once with their nearest vector.  Equal scores go by smaller id.
With fewer candidates than asked for, all are returned.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import mix64, released, written

TABLES, AXES, STEPS = 4, 10, 3
#: Widths of a step to choose from, in standard deviations of a projection.
WIDTHS = (0.6, 0.8, 1.0, 1.25)
#: Rows to fit the lattice on, those of them that ask, and the recall to reach among them.
SAMPLE, ASKING, GOAL = 4096, 256, 0.95
#: Rows of a block, and queries that are answered at once.
BLOCK, QUERIES = 16384, 128


class Lattice:
    def __init__(self, sample: np.ndarray, k: int = 5, seed: int = 7) -> None:
        """Fits offsets, width and share to a sample of unit vectors."""
        rng = np.random.default_rng(seed)
        self.axes = rng.normal(size=(sample.shape[1], TABLES * AXES))
        placed = sample @ self.axes
        self.middle, spread = np.median(placed, axis=0), np.maximum(placed.std(axis=0), 1e-9)
        self.share, self.width = 2.0, spread
        for width in WIDTHS:
            before, self.width = self.width, width * spread
            share = self._share(sample, k)
            if share < self.share:
                self.share = share
            else:
                self.width = before

    def places(self, unit: np.ndarray) -> np.ndarray:
        """(rows, TABLES, AXES): projections in steps, from the lower end of the lowest."""
        return ((unit @ self.axes - self.middle) / self.width + STEPS / 2).reshape(len(unit), TABLES, AXES)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, TABLES): the number of the cell in each table."""
        return np.clip(np.floor(self.places(unit)), 0, STEPS - 1).astype(np.int64) @ STEPS ** np.arange(AXES)

    @staticmethod
    def marks(cells: np.ndarray) -> np.ndarray:
        """(cells, AXES * STEPS): a one for the step of each axis."""
        steps = cells[:, None] // STEPS ** np.arange(AXES) % STEPS
        return (steps[:, :, None] == np.arange(STEPS)).reshape(len(cells), -1).astype(float)

    def far(self, marks: np.ndarray, places: np.ndarray, t: int) -> np.ndarray:
        """(queries, cells): squared distance from projections to the cells of a table, given by their marks."""
        low = np.arange(STEPS, dtype=float)
        high = low + 1
        low[0], high[-1] = -np.inf, np.inf
        gap = np.maximum(0.0, np.maximum(low - places[:, :, None], places[:, :, None] - high))
        width = self.width.reshape(TABLES, AXES)[t]
        return ((gap * width[None, :, None]) ** 2).reshape(len(places), -1) @ marks.T

    def _share(self, sample: np.ndarray, k: int) -> float:
        asking = sample[: min(ASKING, len(sample))]
        near = asking @ sample.T
        near[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1.0
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        least, places = np.ones(best.shape), self.places(sample)
        for t in range(TABLES):
            marks = self.marks(np.clip(np.floor(places[:, t]), 0, STEPS - 1).astype(np.int64) @ STEPS ** np.arange(AXES))
            far = self.far(marks, places[: len(asking), t], t)
            order = np.sort(far, axis=1)
            for i in range(len(asking)):
                # A hair above: sums of the same terms may differ in the last place.
                least[i] = np.minimum(least[i], np.searchsorted(order[i], far[i, best[i]] + 1e-9, side="right") / len(sample))
        return float(np.quantile(least, GOAL, method="higher"))


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows take part, their vectors as doubles, those at unit length)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    size = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return np.flatnonzero(good), flat[good], flat[good] / size[good, None]


class Directory:
    """Row counts of all cells, and the blocks where their rows lie."""

    def __init__(self, rows: list, lattice: Lattice) -> None:
        self.lattice, self.cell, self.count, self.first, self.salts, block = lattice, [], [], [], [], 0
        for t in range(TABLES):
            own = sorted((r["cell"], r["n"]) for r in rows if r["t"] == t)
            first, salts, held = [], [], 0
            for _, n in own:
                if held and held + n > BLOCK:
                    block, held = block + 1, 0
                first.append(block)
                salts.append(max(1, -(-n // BLOCK)))
                held += n
                if held > BLOCK:
                    block, held = block + salts[-1], 0
            block += 1
            self.cell.append(np.array([c for c, _ in own], np.int64))
            self.count.append(np.array([n for _, n in own], np.int64))
            self.first.append(np.array(first, np.int64))
            self.salts.append(np.array(salts, np.int64))

    def blocks(self, cells: np.ndarray, ids: np.ndarray, t: int) -> np.ndarray:
        at = np.searchsorted(self.cell[t], cells)
        return self.first[t][at] + (mix64(ids.astype(np.uint64)) % self.salts[t][at].astype(np.uint64)).astype(np.int64)

    def visits(self, unit: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the cells (places in the directory) that it visits in a table, and the blocks where they lie; in order of blocks."""
        marks = self.lattice.marks(self.cell[t])
        enough = self.lattice.share * self.count[t].sum()
        for i in range(0, len(unit), QUERIES):
            far = self.lattice.far(marks, self.lattice.places(unit[i : i + QUERIES])[:, t], t)
            for order in np.argsort(far, axis=1, kind="stable"):
                cells = np.sort(order[: int(np.searchsorted(np.cumsum(self.count[t][order]), enough)) + 1])
                salts = self.salts[t][cells]
                block = np.repeat(self.first[t][cells], salts) + np.arange(salts.sum()) - np.repeat(np.cumsum(salts) - salts, salts)
                yield np.repeat(cells, salts), block


LAID = "block long, role int, vec_id long, cell int, vector binary, visits binary"


def _lay(vectors: DataFrame, directory, dim: int, queries: bool) -> DataFrame:
    """Rows to their blocks, or queries to the blocks they visit."""
    names, types = [c.split()[0] for c in LAID.split(", ")], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d: Directory = directory.value
        for batch in batches:
            for k in range(0, batch.num_rows, QUERIES if queries else 1024):
                part = batch.slice(k, QUERIES if queries else 1024)
                good, vector, unit = unit_vectors(part.column("embedding"), dim)
                ids, cells = part.column("vec_id").to_numpy()[good], d.lattice.cells(unit)
                for t in range(TABLES):
                    out = []
                    if queries:
                        for i, (visited, block) in enumerate(d.visits(unit, t)):
                            # Cells are in order of blocks, but for those dealt over several.
                            order = np.argsort(block, kind="stable")
                            each, first = np.unique(block[order], return_index=True)
                            out += [(b, 1, int(ids[i]), t, vector[i].tobytes(), v.astype("<i4").tobytes()) for b, v in zip(each.tolist(), np.split(visited[order], first[1:]), strict=True)]
                    else:
                        block, at = d.blocks(cells[:, t], ids, t), np.searchsorted(d.cell[t], cells[:, t])
                        out = [(int(block[i]), 0, int(ids[i]), int(at[i]), vector[i].tobytes(), None) for i in range(len(ids))]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True)], names)

    return vectors.mapInArrow(released(task), LAID)


class Block:
    """The rows of a block in the order of their cells, for queries that pass by."""

    def __init__(self, rows: list[dict], dim: int, k: int) -> None:
        rows = sorted(rows, key=lambda r: r["cell"])
        self.k, self.vector = k, np.frombuffer(b"".join(r["vector"] for r in rows)).reshape(-1, dim)
        self.size = np.sqrt((self.vector * self.vector).sum(axis=1))
        self.short = (self.vector / self.size[:, None]).astype(np.float32)
        self.ids = np.array([r["vec_id"] for r in rows])
        self.cells, self.first = np.unique(np.array([r["cell"] for r in rows]), return_index=True)
        self.end = np.append(self.first[1:], len(rows))
        #: Rows multiplied with queries so far.
        self.products = 0

    def best(self, queries: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the nearest of the rows in the cells that it visits."""
        for r in queries:
            q = np.frombuffer(r["vector"])
            size = np.sqrt((q * q).sum())
            visited = np.frombuffer(r["visits"], "<i4")
            among = np.searchsorted(self.cells, visited).clip(max=len(self.cells) - 1)
            among = among[self.cells[among] == visited]
            n = self.end[among] - self.first[among]
            at = np.repeat(self.first[among], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = at[self.ids[at] != r["vec_id"]]
            if not len(at):
                continue
            self.products += len(at)
            if len(at) > self.k:
                # Single precision is off by less than the margin.
                about = self.short[at] @ (q / size).astype(np.float32)
                least = np.partition(about, len(at) - self.k)[len(at) - self.k]
                at = at[about >= least - 1e-5]
            # The same sum for the same vectors, wherever they lie.
            score = (q * self.vector[at]).sum(axis=1) / (size * self.size[at])
            order = np.lexsort((self.ids[at], -score))
            _, once = np.unique(self.ids[at][order], return_index=True)
            order = order[np.sort(once)][: self.k]
            yield r["vec_id"], self.ids[at][order], score[order]


def _search(laid: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each block for each of its queries."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, block, queries = None, [], None, []

        def found() -> Iterator[pa.RecordBatch]:
            hits = list(block.best(queries)) if block and queries else []
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in hits]), pa.int64()), pa.array(np.concatenate([i for _, i, _ in hits]), pa.int64()), pa.array(np.concatenate([s for *_, s in hits]), pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != now:
                    yield from found()
                    now, rows, block, queries = r["block"], [], None, []
                if r["role"] == 0:
                    rows.append(r)
                    continue
                if rows:
                    block, rows = Block(rows, dim, k), []
                queries.append(r)
                if len(queries) == QUERIES:
                    yield from found()
                    queries = []
        yield from found()

    return laid.repartition("block").sortWithinPartitions("block", "role").mapInArrow(released(task), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of vectors (vec_id, embedding): for each query its k nearest found."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks")).filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    common = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    dim = common[0]["dim"]
    vectors = vectors.filter(F.size("embedding") == dim)
    # SAMPLE rows, the same for the same table.
    some = vectors.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").collect()
    sample = unit_vectors(pa.array([r["embedding"] for r in some], pa.list_(pa.float64())), dim)[2]
    if not len(sample):
        sample = np.ones((1, dim))
    lattice = Lattice(sample, k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = lattice.cells(unit_vectors(batch.column("embedding"), dim)[2])
            for t in range(TABLES):
                cell, n = np.unique(cells[:, t], return_counts=True)
                yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(cell), t), pa.int32()), "cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    # At most TABLES * STEPS ** AXES rows.
    counts = vectors.select("embedding").mapInArrow(released(count), "t int, cell long, n long").groupBy("t", "cell").agg(F.sum("n").alias("n")).collect()
    if not counts:
        return spark.createDataFrame([], schema)
    directory = spark.sparkContext.broadcast(Directory(counts, lattice))
    every = vectors.select("vec_id", "embedding", "asks")
    laid = _lay(every.filter("asks").drop("asks"), directory, dim, True).unionByName(_lay(every.drop("asks"), directory, dim, False))
    found = written(_search(laid, dim, k), "found").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
