from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search, vectorindex
from tessera.operators.textindex import TextIndex
from tessera.operators.vectorindex import VectorIndex
from tessera.plans.filters import And, Eq, Layout, Not


def drawn(n, dims=16, seed=1, groups=0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims))
    if groups:
        x = x * 0.2 + draw.normal(size=(groups, dims))[draw.integers(0, groups, n)]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v], str(i % 5)) for i, v in enumerate(x)], "id long, embedding array<double>, label string").repartition(3)


def nearest(x, question, k, keep=None):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit[question]
    near[question] = -np.inf
    if keep is not None:
        near[~keep] = -np.inf
    order = sorted(range(len(x)), key=lambda i: (-near[i], i))[:k]
    return [i for i in order if near[i] > -np.inf]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    x = drawn(3000, groups=40)
    return x, VectorIndex.build(frame(spark, x), f"file://{tmp_path_factory.mktemp('v')}/index", filters=("label",), k=10, per_cell=60)


def found(rows):
    out = {}
    for r in rows.orderBy("question", "rank").collect():
        out.setdefault(r.question, []).append(r.key)
    return out


def test_exact_over_all_cells(spark, clustered):
    x, index = clustered
    asked = frame(spark, x).filter("id % 20 = 0")
    got = found(index.knn_many(asked, 10, exact=True))
    assert got == {q: nearest(x, q, 10) for q in range(0, 3000, 20)}


def test_few_cells_and_few_vectors_are_enough(spark, clustered):
    x, index = clustered
    assert index.visits < len(index.centres) / 4
    rows = index.knn_many(frame(spark, x).filter("id % 20 = 0"), 10)
    got = found(rows)
    right = sum(len(set(got[q]) & set(nearest(x, q, 10))) for q in range(0, 3000, 20)) / 1500
    read = rows.groupBy("question").agg(F.max("scored").alias("n")).agg(F.avg("n")).first()[0]
    assert right >= 0.9 and read <= 0.02 * 3000


def test_filters_hold_for_candidates(spark, clustered):
    x, index = clustered
    where, layout = And((Not(Eq("dataset", "3")),)), Layout(columns={"dataset": "label"})
    keep = np.arange(3000) % 5 != 3
    got = found(index.knn_many(frame(spark, x).filter("id in (5, 8, 1003)"), 7, where=where, layout=layout, exact=True))
    assert got == {q: nearest(x, q, 7, keep) for q in (5, 8, 1003)}
    plan = index.rows().filter("label = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,1)]" in plan


def test_vectors_without_much_structure_need_few_reads(spark, tmp_path):
    x = drawn(2000, 64)
    index = VectorIndex.build(frame(spark, x), f"file://{tmp_path}/index", k=5, per_cell=100)
    rows = index.knn_many(frame(spark, x).filter("id % 20 = 0"), 5)
    got = found(rows)
    assert sum(len(set(got[q]) & set(nearest(x, q, 5))) for q in range(0, 2000, 20)) >= 0.9 * 500
    assert rows.agg(F.max("scored")).first()[0] <= 0.2 * 2000


def test_odd_vectors_ties_and_more_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, None]), (9, [1.0]), (10, [])]
    given = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = VectorIndex.build(given, f"file://{tmp_path}/index", k=3)
    assert found(index.knn_many(given, 5)) == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    index.append(spark.createDataFrame([(0, [5.0, 0.0])], given.schema))
    assert [r.key for r in index.knn([2.0, 0.0], 3).orderBy(F.col("similarity").desc(), "key").collect()] == [0, 1, 2]
    empty = VectorIndex.build(given.limit(0), f"file://{tmp_path}/empty")
    assert empty.knn_many(given, 5).collect() == [] and index.knn_many(given.limit(0), 5).collect() == []


def test_hot_cells_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "ROWS", 7)
    monkeypatch.setattr(vectorindex, "QUESTIONS", 3)
    x = np.repeat(drawn(3, 8), 60, axis=0) + drawn(180, 8, 2) * 1e-3
    index = VectorIndex.build(frame(spark, x), f"file://{tmp_path}/index", per_cell=60)
    assert found(index.knn_many(frame(spark, x), 4, exact=True)) == {q: nearest(x, q, 4) for q in range(180)}


def test_hybrid_for_many_questions_is_that_of_each(spark, clustered):
    x, index = clustered
    words = ["pool", "bar", "log", "warm"]
    texts = spark.createDataFrame([(i, " ".join(words[(i * j) % 4] for j in range(1, i % 7 + 2))) for i in range(3000)], "id long, text string")
    text = TextIndex.of(texts)
    asked = frame(spark, x).filter("id in (3, 40)").select(F.col("id").alias("question"), F.col("embedding").alias("vector"), F.when(F.col("id") == 3, F.array(F.lit("pool"), F.lit("bar"))).otherwise(F.array(F.lit("log"))).alias("terms"))
    got = {(r.question, r.id): (r.rank, round(r.score, 12)) for r in search.hybrid_many(index, text, asked, 6, exact=True, itself=True).collect()}
    for question, terms in ((3, ["pool", "bar"]), (40, ["log"])):
        legs = [search.ranked(index.knn(list(x[question]), exact=True).withColumnRenamed("key", "id"), "similarity", "id", "v"), search.ranked(text.bm25(terms), "score", "id", "t")]
        want = search.top(search.fuse(legs, "id"), "score", "id", 6).collect()
        assert [(i, round(r.score, 12)) for i, r in enumerate(want, 1)] == [got[(question, r.id)] for r in want]


def test_questions_are_not_copied_for_each_cell(spark, clustered):
    x, index = clustered
    asked = frame(spark, x).filter("id % 20 = 0").select(F.col("id").alias("question"), F.col("embedding").alias("asked"))
    rows = index._dealt(index.rows(), asked).select("part", "role", F.length("ids") / 8).collect()
    parts, cells = len({r[0] for r in rows if r[1] == 0}), len(index.centres)
    assert sum(r[2] for r in rows if r[1] == 0) == 150 * parts and parts < cells / 4
    assert sum(r[2] for r in rows if r[1] == 1) == 3000
