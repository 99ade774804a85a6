from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import neighbours


def exact(ids, vectors, query, k=5):
    v = np.array(vectors, float)
    n = np.sqrt((v * v).sum(1))
    i = ids.index(query)
    score = (v[i] * v).sum(1) / (n[i] * n)
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != query]
    return [(ids[j], score[j]) for j in order[:k]]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, block string, rank int")


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)  # the driver deals cells over blocks
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(2500, 24)).astype(np.float32)
    vectors[300:900] = vectors[300]  # one vector that many rows share
    ids = list(range(2500))
    rows = neighbours.nearest(table(spark, [(i, vectors[i].tolist()) for i in ids]), F.col("vec_id") % 10 == 0).collect()
    hits = 0
    for q in range(0, 2500, 10):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r.query_id == q)
        want = exact(ids, vectors, q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        hits += len({g[1] for g in got} & {w[0] for w in want})
        everything = dict(exact(ids, vectors, q, 2500))
        assert all(abs(s - everything[i]) < 1e-12 for _, i, s in got)
        if 300 <= q < 900:
            assert [g[1] for g in got] == [i for i in range(300, 310) if i != q][:5]
    assert hits / 1250 >= 0.9


def visited(vectors, k=5):
    """(share of the rows that a query's cells hold together, products for each query and row, recall) of the lattice fitted to these vectors."""
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    lattice = neighbours.Lattice(unit[: neighbours.SAMPLE], k)
    cells = lattice.cells(unit)
    rows = [{"t": t, "cell": int(c), "n": int(n)} for t in range(neighbours.TABLES) for c, n in zip(*np.unique(cells[:, t], return_counts=True), strict=True)]
    directory = neighbours.Directory(rows, lattice)
    ask = np.arange(0, len(unit), 50)
    seen, products = np.zeros((len(ask), len(unit)), bool), 0
    for t in range(neighbours.TABLES):
        at = np.searchsorted(directory.cell[t], cells[:, t])
        for i, (found, _) in enumerate(directory.visits(unit[ask], t)):
            seen[i] |= np.isin(at, found)
            products += np.isin(at, found).sum()
    near = unit[ask] @ unit.T
    near[np.arange(len(ask)), ask] = -2
    best = np.argsort(-near, axis=1)[:, :k]
    return seen.mean(), products / seen.size, np.take_along_axis(seen, best, axis=1).mean()


def test_rows_visited_follow_the_structure(sf):
    """Little of a table with clusters, less than half of one whose vectors have no near neighbours."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 32))
    clustered = np.repeat(centres, 30, axis=0) + 0.2 * rng.normal(size=(6000, 32))
    share, products, recall = visited(clustered)
    assert share < 0.1 and products < 0.2 and recall >= 0.9
    given = np.array(pq.read_table(sf.replace("sf0.001", "sf0.1") + "/embeddings.parquet")["embedding"].to_pylist(), float)
    share, products, recall = visited(given)
    assert share < 0.6 and products < 0.8 and recall >= 0.9


def test_a_block_multiplies_visited_rows_only():
    rng = np.random.default_rng(5)
    rows = [{"vec_id": i, "cell": i % 7, "vector": rng.normal(size=8).tobytes()} for i in range(70)]
    block = neighbours.Block(rows, 8, 3)
    asked = [{"vec_id": 3, "vector": rows[3]["vector"], "visits": np.array([1, 3, 9], "<i4").tobytes()}, {"vec_id": 900, "vector": rows[4]["vector"], "visits": np.array([40], "<i4").tobytes()}]
    found = list(block.best(asked))
    assert block.products == 19 and [q for q, *_ in found] == [3] and all(i % 7 in (1, 3) and i != 3 for i in found[0][1])


def test_cells_follow_width_and_offset():
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(500, 12))
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    lattice = neighbours.Lattice(unit)
    steps = np.clip(np.floor((unit @ lattice.axes - lattice.middle) / lattice.width + neighbours.STEPS / 2), 0, neighbours.STEPS - 1).reshape(500, neighbours.TABLES, -1)
    assert (lattice.cells(unit) == (steps * neighbours.STEPS ** np.arange(neighbours.AXES)).sum(axis=2)).all()
    # Nothing is nearer than the own cell, and a step away is as far as its edge.
    cells = np.unique(lattice.cells(unit)[:, 0])
    far = lattice.far(lattice.marks(cells), lattice.places(unit)[:, 0], 0)
    assert (far[np.arange(500), np.searchsorted(cells, lattice.cells(unit)[:, 0])] == 0).all() and (far >= 0).all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (100, None), (150, [])]
    good = [(0, [1.0, 0.0]), (7, [1.0, 0.1]), (8, [0.0, 1.0]), (8, [1.0, 0.2]), (50, [-1.0, 0.0])]
    rows = neighbours.nearest(table(spark, bad + good), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 7), (0, 2, 8), (0, 3, 50), (50, 1, 8), (50, 2, 7), (50, 3, 0)]
    assert neighbours.nearest(table(spark, bad[:2]), F.lit(True)).count() == 0
    assert neighbours.nearest(table(spark, good).limit(0), F.lit(True)).count() == 0
