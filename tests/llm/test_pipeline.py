from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
from tessera.llm import mixing, toxicity
from tessera.llm.common import documents


def five(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def smallest_of_each(docs):
    grams = {i: five(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, g in grams.items():
        for x in g:
            by[x].add(i)
    for i, g in grams.items():
        for j in {j for x in g for j in by[x] if j < i}:
            if 100 * len(g & grams[j]) >= 80 * len(g | grams[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: t for i, t in docs.items() if top(i) == i}


def test_stages_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    labels = documents(spark, sf, "labels")
    kept = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).collect() if not r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    step = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        step = stage(spark, step, sf)
        assert step.columns == docs.columns
        if k == 0:
            assert {r.doc_id for r in step.collect()} == kept
        if k == 1:
            first = {}
            for i in sorted(texts):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
            texts = {i: texts[i] for i in first.values()}
            assert {r.doc_id for r in step.collect()} == set(texts)
    texts = smallest_of_each(texts)
    assert {r.doc_id: r.text for r in step.collect()} == texts and len(texts) < len(kept)
    copies = {r.doc_id: r.copies for r in mixing.mix(step).collect() if r.copies}
    mixed = corpus_pipeline.STAGES[3][1](spark, step, sf)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(copies)
    pieces = corpus_pipeline.run(spark, sf).collect()
    per = defaultdict(int)
    for r in pieces:
        per[r.doc_id] += r.length
    size = {r.doc_id: r.doc_tokens for r in pieces}
    assert per == {i: n * size[i] for i, n in copies.items()}
    assert len({r.sequence_id for r in pieces}) == len(pieces)


def test_run_with_odd_rows_leaves_one_table(spark, tmp_path):
    """Null and repeated ids, empty and equal texts, a null source, another column: no text is lost, none stays twice."""
    from tessera.llm import common

    words = lambda seed, n: " ".join(f"w{(seed * 7919 + i * 104729) % 9973}" for i in range(n))
    rows = [(1, "same text here"), (None, "same  text here"), (4, words(1, 60)), (4, words(2, 60)), (None, words(3, 60)), (None, words(4, 60)), (7, words(2, 60)), (8, None), (9, ""), (10, words(5, 9000))]
    docs = spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", 0, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
    left = sorted((re.sub(r"\s+", " ", r.text or "") for r in step.collect()))
    assert left == sorted({re.sub(r"\s+", " ", t or "") for _, t in rows})
    before = set(common._WRITTEN)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(set(common._WRITTEN) - before) == 1
    # An empty table goes through all stages.
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
