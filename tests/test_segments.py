from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import segments
from tessera.operators.segments import SegmentedIndex
from tessera.operators.textindex import TextIndex

WORDS = ["pool", "bar", "boiler", "log", "warm", "clean", "the", "failed"]


def texts(draw, ids):
    return [(i, " ".join(draw.choices(WORDS, [9, 5, 3, 2, 2, 1, 20, 1], k=draw.randrange(0, 30)))) for i in ids]


def ranked(docs, terms, k):
    """BM25 by its formula."""
    words = {i: t.split() for i, t in docs.items()}
    average = sum(map(len, words.values())) / len(words)
    out = dict.fromkeys(words, 0.0)
    for t in terms:
        n = sum(t in w for w in words.values())
        idf = math.log((len(words) - n + 0.5) / (n + 0.5))
        for i, w in words.items():
            tf = w.count(t)
            out[i] += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average)) if tf else 0.0
    return [(i, round(s, 9)) for i, s in sorted(out.items(), key=lambda x: (-x[1], x[0])) if s][:k]


@pytest.fixture
def index(spark, tmp_path):
    return SegmentedIndex(spark, f"file://{tmp_path}/index")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def agrees(index, truth, k=10):
    for terms in (["boiler"], ["pool", "bar", "clean"], ["the", "log"]):
        got = [(r.id, round(r.score, 9)) for r in index.bm25(terms, k).collect()]
        want = ranked(truth, terms, k)
        assert [s for _, s in got] == [s for _, s in want]
        assert {i for i, s in got if s > want[-1][1]} == {i for i, s in want if s > want[-1][1]}


def test_segments_follow_changes(spark, index):
    draw, truth = random.Random(2), {}
    first = texts(draw, range(700))
    index.add(frame(spark, first))
    truth |= dict(first)
    agrees(index, truth)
    old = index.state()["segments"][0]["name"]
    more = texts(draw, range(690, 760))
    index.update(frame(spark, more))
    truth |= dict(more)
    gone = draw.sample(sorted(truth), 90)
    index.delete(spark.createDataFrame([(i,) for i in [*gone, 10_000]], "id long"))
    for i in gone:
        del truth[i]
    agrees(index, truth)
    state = index.state()
    assert [s["name"] for s in state["segments"]][0] == old and len(state["segments"]) == 2
    assert index.totals() == (len(truth), sum(len(t.split()) for t in truth.values()))
    # Phrases and densities over the live texts, as by an index of them.
    whole = TextIndex.of(frame(spark, list(truth.items())))
    for line in ('"pool bar" or boiler -log', "the warm"):
        rows = lambda x: [(r.id, round(r.score, 9)) for r in x.search(line, None).orderBy("id").collect()]  # noqa: B023, E731
        assert rows(index.index()) == rows(whole)
    merged = index.merge(1)
    assert len(merged["segments"]) == 1 and merged["dead"] is None and index.totals()[0] == len(truth)
    agrees(index, truth)
    index.delete(spark.createDataFrame([(next(iter(truth)),)], "id long"))
    truth.pop(next(iter(truth)))
    agrees(index, truth)
    assert index.vacuum()
    agrees(index, truth)


def test_blocks_below_the_kth_score_are_passed_over(spark, index):
    # One text in ten thousand names the boiler often; others do once, in long texts.
    rows = [(i, "boiler boiler boiler boiler" if i % 1000 == 7 else "boiler " + "the " * 60) for i in range(10_000)]
    index.add(spark.createDataFrame(rows, "id long, text string").coalesce(1))
    blocks, average = index._weighted(["boiler"], index.state())
    assert blocks.count() == 79 and index.reaching(blocks, average, 5).count() <= 10
    assert {r.id % 1000 for r in index.bm25(["boiler"], 10).collect()} == {7}


def test_stems_empty_and_null_texts(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/stems", stem=True)
    assert index.bm25(["pool"]).collect() == [] and index.index().search("pool").collect() == []
    assert index.add(frame(spark, []))["segments"] == []
    index.add(frame(spark, [(1, None), (2, ""), (3, "the pools of Naïve guests"), (4, "pooling"), (5, "word " * 20_000)]))
    assert sorted(r.id for r in index.bm25(index.terms(["Pool"])).collect()) == [3, 4]
    assert [r.id for r in index.bm25(index.terms(["words"])).collect()] == [5]
    index.delete(frame(spark, [(i, "") for i in range(1, 6)]).select("id"))
    assert index.state()["segments"] == [] and index.bm25(["pool"]).collect() == []


def test_sync_reads_new_files_only(spark, index, tmp_path):
    path = f"file://{tmp_path}/table"
    draw = random.Random(5)
    one, two, three = (texts(draw, range(100 * n, 100 * n + 60)) for n in range(3))
    for n, rows in enumerate((one, two)):
        frame(spark, rows).coalesce(1).write.parquet(f"{path}/f={n}")
    read = lambda: spark.read.parquet(path)
    first = index.sync(read())
    assert first["segments"][0]["docs"] == 120 and index.sync(read())["version"] == first["version"]
    frame(spark, three).coalesce(1).write.parquet(f"{path}/f=2")
    frame(spark, [(7, "boiler again")]).coalesce(1).write.mode("overwrite").parquet(f"{path}/f=0")
    after = index.sync(read())
    assert [s["docs"] for s in after["segments"]] == [120, 61] and after["segments"][0]["dead_docs"] == 60
    agrees(index, dict(two) | dict(three) | {7: "boiler again"})
    assert index.index().postings.filter(F.col("term") == "again").count() == 1


@pytest.mark.parametrize("stem", [False, True])
def test_postings_do_not_shuffle(spark, tmp_path, monkeypatch, stem):
    """Posting rows are made where the words are; runs end between blocks, batches and files need not."""
    monkeypatch.setattr(segments, "RUN", 900)
    monkeypatch.setattr(segments, "STAGED", 256)
    plans, store = [], SegmentedIndex._store_postings
    monkeypatch.setattr(SegmentedIndex, "_store_postings", lambda self, rows, name: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), store(self, rows, name)))
    docs = frame(spark, [*texts(random.Random(8), range(900)), (900, "Étages étage pools"), (901, None), (902, "pool " * 2000)])
    index = SegmentedIndex(spark, f"file://{tmp_path}/index", stem)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        index.add(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "REPARTITION" not in plans[0] and "hashpartitioning(term" not in plans[0]
    rows = lambda x: sorted(tuple(r) for r in x.index().postings.collect()) if x is index else sorted(tuple(r) for r in x.postings.collect())
    assert rows(index) == rows(TextIndex.of(docs, stem=stem))
    stored = spark.read.parquet(f"{index.root}/postings")
    assert stored.groupBy("segment", "term", "block").count().filter("count > 1").isEmpty()
    assert stored.filter("max_tf != array_max(transform(docs, d -> d.tf)) or min_length != array_min(transform(docs, d -> d.length))").isEmpty()
