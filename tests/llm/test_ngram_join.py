from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngram_join
from tessera.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(ids, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i in range(len(ids)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[top(i)]) for i in range(len(ids))}


def edited(rng, words, rate):
    return " ".join(w if rng.random() > rate else f"e{rng.integers(1000)}" for w in words)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    base = [[f"w{rng.integers(60)}" for _ in range(rng.integers(30, 220))] for _ in range(6)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [None, "", "a b c", "A b  c", "a b", " \t"]
    for words in base:
        texts += [edited(rng, words, rate) for rate in (0.0, 0.0, 0.01, 0.01, 0.02, 0.02, 0.03, 0.05)]
        texts += [" ".join(words[: len(words) * k // 20]) for k in (20, 19, 18, 17, 15, 14, 12)]
    texts += [edited(rng, base[0], 0.02) for _ in range(60)]
    texts += [f"{passage} x{i}" for i in range(30)] + [f"{passage} " + " ".join(f"y{i}-{k}" for k in range(40)) for i in range(20)]
    return texts


def test_components_against_brute_force(make, corpus):
    ids = [1000 - 3 * i for i in range(len(corpus))]
    rows = ngram_join.jaccard_components(make(corpus, ids), parts=3).collect()
    want = brute(ids, corpus)
    assert len(rows) == len(ids)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len({c for _, c in want.values()}) < len(ids) - 80  # there is something to find
    kept = ngram_join.one_of_each(make(corpus, ids), parts=3)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} and "cell0" in kept.columns


def test_edges(make, odd):
    assert ngram_join.jaccard_components(make(["a"]).limit(0), parts=2).count() == 0
    rows = ngram_join.jaccard_components(make(odd), parts=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(list(range(len(odd))), odd)
    rows = ngram_join.jaccard_components(make(["a b c d e", "a b c d e", "x", None], ids=[None, 4, 4, 5]), parts=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (4, 0), (4, 4), (5, 5)]


def test_one_of_each_decides_for_each_row(make):
    def left(texts, ids):
        return sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(make(texts, ids), parts=2).collect()), key=str)

    assert left(["a b c d e", "a b c d e", "f g h i j"], [1, 2, 2]) == [(1, "a b c d e"), (2, "f g h i j")]
    assert left(["a b c d e", "A b c d e", "f g h i j", "k l m n o"], [4, 4, None, None]) == [(4, "a b c d e"), (None, "f g h i j"), (None, "k l m n o")]
    assert left(["a b c d e", "a b c d e"], [3, None]) == [(None, "a b c d e")]
    assert left(["", None, "x"], [1, 1, 1]) == [(1, ""), (1, "x"), (1, None)]


def test_packed_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 4000):
        keys = np.sort(rng.integers(0, 1 << 30, n)).astype(np.uint64)
        assert (ngram_join.unpacked(ngram_join.packed(keys)) == keys.astype(np.int64)).all()
    assert ngram_join.unpacked(ngram_join.packed(np.array([0, 0, 65535, 131070], np.uint64))).tolist() == [0, 0, 65535, 131070]


def test_packed_room_follows_the_numbers():
    """However many parts numbers are dealt over, and so however far apart they lie, each takes four bytes and some at most."""
    rng = np.random.default_rng(1)
    for n in (1, 40, 437, 1 << 14):
        for top in (1 << 10, 1 << 20, 1 << 30):
            keys = np.sort(rng.integers(0, top, n)).astype(np.uint64)
            data = ngram_join.packed(keys)
            assert len(data) <= 5 * n + 8, (n, top)
            assert (ngram_join.unpacked(data) == keys.astype(np.int64)).all()


def test_labels_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199)]
    label = {r.node: r.label for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert {label[i] for i in range(41)} == {0} and {label[100 + i] for i in range(30)} == {100} and label[200] == 199


def test_a_group_of_more_rows_than_a_block(make, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    texts = [edited(rng, base, 0.004) for _ in range(330)] + [" ".join(f"o{i}-{k}" for k in range(50)) for i in range(40)]
    want = brute(list(range(len(texts))), texts)
    for block in (256, 8):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        rows = ngram_join.jaccard_components(make(texts), parts=5).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want, block


def test_block_product_against_sets(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    rows, columns = sets[:25], sets[15:]
    for entries in (1, 7, 1 << 20):
        monkeypatch.setattr(ngram_join, "ENTRIES", entries)
        product = ngram_join.Columns(list(range(15, 40)), columns)
        assert product.times(rows).tolist() == [[len(np.intersect1d(a, b)) for b in columns] for a in rows]
    asked = [np.sort(rng.choice(np.arange(15, 40), rng.integers(0, 9), replace=False)) for _ in rows]
    got = {(int(a), int(b)): int(n) for a, b, n in zip(*product.linked(rows, asked, 50), strict=True)}
    want = {(i, int(j)): len(np.intersect1d(sets[i], sets[j])) for i in range(25) for j in asked[i]}
    assert got == {k: n for k, n in want.items() if 100 * n >= 50 * (len(sets[k[0]]) + len(sets[k[1]]) - n)}


def test_sets_are_taken_a_few_bytes_at_a_time(monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 64)
    sizes = [3, 0, 5, 40, 1, 8, 2, 0]
    batch = pa.RecordBatch.from_pydict({"class": list(range(8)), "grams": [np.arange(n, dtype="<u8").tobytes() for n in sizes]})
    runs = [r.column("class").to_pylist() for r in ngram_join.few(batch, "grams")]
    assert [i for r in runs for i in r] == list(range(8)) and [3] in runs
    assert all(len(r) == 1 or sum(sizes[i] for i in r) <= 8 for r in runs)
