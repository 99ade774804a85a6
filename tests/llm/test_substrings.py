from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import substrings
from tessera.llm.suffix_sort import sort_suffixes


def brute(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n):
    return " ".join(f"w{x}é" if x % 7 == 0 else f"w{x}" for x in rng.integers(0, 10**6, n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    base = [words(rng, 300) for _ in range(5)]
    long, exact, short = words(rng, 120), words(rng, 70)[:400], words(rng, 70)[:399]
    texts = [None, "", "short", "ab" * 700, "ab" * 300, "x" * 401, "y" * 400]
    texts += [base[0], base[0], base[1] + " tail", "head " + base[1], base[2][200:1500], base[2]]
    texts += [words(rng, 30) + long + words(rng, 30) for _ in range(40)]
    texts += [words(rng, 20) + exact + words(rng, 20) for _ in range(10)] + [words(rng, 20) + short + words(rng, 20) for _ in range(10)]
    texts += [base[3][:900] + "X" + base[3][900:], base[3], base[4] + base[4][100:700] + words(rng, 10)]
    return texts


@pytest.mark.parametrize("most", [4096, 3])
def test_removal_against_brute_force(make, corpus, most, monkeypatch):
    """With at most 3 contexts in a task, the split of anchors runs to single windows."""
    monkeypatch.setattr(substrings, "PIECE", 700)
    monkeypatch.setattr(substrings, "SLICE", 5000)
    rows = substrings.digest(substrings.without_repeats(make(corpus), most=most)).collect()
    want = brute(corpus, 400)
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert sum(w[1] for w in want) > 20_000


def test_passages_of_over_fifty_words(make):
    """Too short to be removed, yet found in every place; texts without one have none."""
    rng = np.random.default_rng(11)
    short = words(rng, 30)
    passage = " ".join(f"w{x}" for x in rng.integers(1000, 9999, 53))
    texts = [words(rng, 40) + " " + passage + " " + words(rng, 40) for _ in range(3)]
    texts += [words(rng, 40) + " " + short + " " + words(rng, 40) for _ in range(3)] + [words(rng, 200), None, ""]
    rows = {r.doc_id: r for r in substrings.digest(substrings.without_repeats(make(texts))).collect()}
    assert len(passage.encode()) < 400
    for i in range(len(texts)):
        assert rows[i].n_removed == 0 and rows[i].n_passages == (1 if i < 3 else 0), i
    assert all(len(passage.encode()) <= rows[i].n_passage_bytes <= len(passage.encode()) + 8 for i in range(3))


def test_very_long_texts_lose_nothing_at_the_edges_of_pieces():
    """What an anchor stands for is the same however a text is cut."""
    import pyarrow as pa

    from tessera.llm.common import string_bytes

    rng = np.random.default_rng(4)
    data, offsets = string_bytes(pa.array([words(rng, 3000)]))
    seen = set()
    for piece, most in ((1 << 19, 1 << 20), (700, 5000), (4096, 4096)):
        windows = set()
        for some in substrings.Anchors(400, 128, piece, most).pieces(data, offsets):
            found = substrings.Anchors(400, 128, piece, most).of(some)
            for key, start, width, lead in zip(found["key"], found["start"], found["width"], found["lead"], strict=True):
                windows |= {(int(start) + k, int(key), int(lead) - k) for k in range(width)}
        assert len(windows) == len(data) - 399
        seen.add(frozenset(windows))
    assert len(seen) == 1


def test_edges(make, odd):
    assert substrings.without_repeats(make(["a"]).limit(0)).count() == 0
    rows = substrings.digest(substrings.without_repeats(make([*odd, odd[7], odd[7]], ids=[*range(len(odd)), None, None]))).collect()
    want = brute([*odd, odd[7], odd[7]], 400)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(want)


def test_suffix_sort_against_python():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 4, 200):
        data = rng.integers(0, letters, 3000).astype(np.uint8)
        at = rng.integers(0, 2990, 500)
        length = np.minimum(rng.integers(0, 80, 500), 3000 - at)
        group = np.sort(rng.integers(0, 40, 500))
        order, common = sort_suffixes(data, at, length, group)
        text = lambda i: data[at[i] : at[i] + length[i]].tobytes()
        assert [(group[i], text(i)) for i in order] == sorted((group[i], text(i)) for i in range(500))
        for a, b, n in zip(order, order[1:], common[1:], strict=False):
            if group[a] != group[b]:
                assert n == -1
            else:
                s, t = text(a), text(b)
                assert n == next((k for k in range(min(len(s), len(t))) if s[k] != t[k]), min(len(s), len(t)))


def test_a_collision_is_seen():
    from tessera.llm.suffix_sort import BASES, _Sorter

    s = _Sorter(np.frombuffer(b"abcabd", np.uint8), np.array([0, 3]), np.array([3, 3]), BASES[0])
    assert s.verified(np.array([0, 1]), np.array([-1, 2])) and not s.verified(np.array([0, 1]), np.array([-1, 3]))
