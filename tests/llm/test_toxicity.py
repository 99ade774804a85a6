from __future__ import annotations

import math
import zlib
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import toxicity


def brute_kernel(s, t):
    """Gap-weighted subsequences of three letters, by enumeration."""
    total = 0.0
    for a in combinations(range(len(s)), 3):
        for b in combinations(range(len(t)), 3):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += toxicity.DECAY ** (a[2] - a[0] + 1 + b[2] - b[0] + 1)
    return total


@pytest.mark.parametrize(("s", "t"), [("idiot", "idiot"), ("idxioxt", "idiot"), ("banana", "ananas"), ("ab", "abc"), ("zzz", "qqqq"), ("disgustingly", "disgust")])
def test_kernel_against_enumeration(s, t):
    got = toxicity.kernel(toxicity.coded([s], 24), toxicity.coded([t], 12))[0]
    assert math.isclose(got, brute_kernel(s, t), rel_tol=1e-4, abs_tol=1e-6)


def test_segments():
    assert toxicity.segments("You i.d.i.o.t, I d i o t go-od\n") == {"you", "idiot", "i", "d", "o", "t", "good"}
    assert toxicity.segments(None) == toxicity.segments(" \t,") == set()
    assert all(any("moron" in w for w in toxicity.windows("x" * k + "moron" + "y" * 60)) for k in range(50))


@pytest.fixture
def corpus(make, spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(900)]
    texts, labels = [], []
    for i in range(900):
        words = list(rng.choice(vocabulary, rng.integers(5, 120)))
        toxic = int(i % 7 == 0)
        if toxic:
            words.insert(rng.integers(len(words)), str(rng.choice(["grobzak", "grobzaks", "Flumdick!", "flumdicky"])))
        texts.append(" ".join(words))
        labels.append((i, toxic))
    return texts, labels, make(texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_scores_against_a_plain_version(corpus, make):
    """A document's score from the kernel by enumeration, segment by segment."""
    texts, _, docs, table = corpus
    model = toxicity.fit(docs, table)
    assert model.landmarks.telling and len(model.landmarks.strings) > model.landmarks.telling
    assert np.allclose(model.probability(np.sort(np.array([[0.0] * toxicity.BEST, [2.0] * toxicity.BEST]))), sorted(model.probability(np.array([[0.0] * toxicity.BEST, [2.0] * toxicity.BEST]))))

    def similar(a, b):
        letters = lambda x: {ord(c) % 64 for c in x}
        if len(letters(a) & letters(b)) < math.ceil(toxicity.SHARED * len(letters(b))):
            return 0.0
        return brute_kernel(a, b) / math.sqrt(brute_kernel(a, a) * brute_kernel(b, b))

    some = [t for t in texts if len(t.split()) < 14][:6] + ["grobzak"]
    got = [r["__s"] for r in toxicity.with_scores(make(some), model, "__s").orderBy("doc_id").collect()]
    for text, score in zip(some, got, strict=True):
        found = sorted((max(np.array([similar(w, m) for m in model.landmarks.strings]) @ model.map @ model.weight + model.bias for w in toxicity.windows(s)) for s in toxicity.segments(text)), reverse=True)
        best = [*found, *[model.bias] * toxicity.BEST][: toxicity.BEST]
        assert math.isclose(score, 1 / (1 + math.exp(-(np.dot(best, model.slopes) + model.shift))), rel_tol=2e-3, abs_tol=1e-4)


def test_held_out_accuracy(corpus, make):
    texts, labels, docs, table = corpus
    rows = toxicity.toxicity_scores(docs, table).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == 900
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    odd = [None, "", "such a grob-zak here", "such a gro.b.z.a.k", "f l u m d i c k", "nothing ill", "x" * 100_000]
    seen = [r["__s"] for r in toxicity.with_scores(make(odd), toxicity.fit(docs, table), "__s").orderBy("doc_id").collect()]
    assert [s >= 0.3 for s in seen] == [False, False, True, True, True, False, False]
    kept = toxicity.without_toxic(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in rows)


def test_without_a_model_nothing_is_dropped(make, spark):
    docs = make(["a fine day", "another", None])
    bad = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, bad) == 1.0 and toxicity.without_toxic(docs, bad).count() == 3
    # Both labels, but nothing in the texts that they follow.
    some = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")
    for texts in (["word here"] * 20 + ["here"] * 20, [f"{i} {i + 1}" for i in range(40)], [""] * 40):
        assert toxicity.without_toxic(make(texts), some).count() == 40
    assert 0.3 <= toxicity.fit(make([""] * 40), some) < 1


def test_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(make(["a", None]), none).collect()} == {0.0}
    one = spark.createDataFrame([(0, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(make(["a", None]), one).collect()} == {0.0}
    assert toxicity.toxicity_scores(make(["a"]).limit(0), none).count() == 0
