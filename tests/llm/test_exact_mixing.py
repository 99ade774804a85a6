from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from tessera.llm import exact, mixing


def test_exact_groups_against_brute_force(make, odd):
    ids = list(range(len(odd)))
    texts = [*odd, *["same text"] * 50, "same   text"]
    ids = [*ids, *range(100, 151)]
    got = {r.doc_id: r for r in exact.exact_groups(make(texts, ids)).collect()}
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(ids)
    for norm, members in groups.items():
        for i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(members), len(members), i == min(members))
            assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_empty_table_repeats_and_null_ids(make):
    assert exact.exact_groups(make(["a"]).limit(0)).count() == 0
    rows = exact.exact_groups(make(["a", "a", "a", "b"], ids=[4, 4, None, None])).collect()
    assert sorted((r.doc_id or -1, r.kept, r.group_size) for r in rows) == [(-1, False, 3), (-1, True, 1), (4, False, 3), (4, True, 3)]
    kept = exact.without_copies(make(["a", "a ", "b", "a"], ids=[1, 2, 3, 0]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and kept.columns[0] == "doc_id" and "size" in kept.columns


def test_without_copies_decides_for_each_row(make):
    def left(texts, ids):
        return sorted(((r.doc_id, r.text) for r in exact.without_copies(make(texts, ids)).collect()), key=str)

    assert left(["a b", "a  b", "b", "b", "c"], [4, None, None, None, None]) == [(4, "a b"), (None, "b"), (None, "c")]
    assert left(["a", "a", "a", "b"], [4, 4, 5, 5]) == [(4, "a"), (5, "b")]
    # The text "own" has one row; that its id has a copy elsewhere takes nothing from it.
    assert left(["x", "x", "own"], [1, 2, 2]) == [(1, "x"), (2, "own")]
    kept = exact.without_copies(make(["a", "a", None, ""], ids=[None, None, 3, 3]))
    assert kept.columns == make(["a"]).columns and kept.count() == 2


def waterfill(sizes, weights, share, most=2):
    goal, total, open_ = {}, share * sum(sizes.values()), set(sizes)
    while open_:
        level = (total - sum(goal.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > most * sizes[s]}
        if not over:
            return goal | {s: weights[s] * level for s in open_}
        goal |= {s: most * sizes[s] for s in over}
        open_ -= over
    return goal


def test_mix_against_brute_force(make):
    source = [None if i % 11 == 0 else f"s{i % 5 if i % 3 else 0}" for i in range(900)]
    texts = [None if i % 97 == 0 else "w " * (i * 7919 % 40) for i in range(900)]
    rows = mixing.mix(make(texts, source=source)).collect()
    again = mixing.mix(make(texts, source=source)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again) and len(rows) == 900
    size = defaultdict(int)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split())
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = waterfill(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - goal[s]) <= 20, (s, taken[s], goal[s])


def test_inclusion_odds_follow_the_size(make):
    """Documents of three times the words are drawn about three times as often; those past 1 always."""
    texts = ["w " * (3 if i % 2 else 1) for i in range(4000)] + ["w " * 5000]
    rows = mixing.mix(make(texts), share=0.6).collect()
    share = lambda n: sum(r.taken > 0 for r in rows if r.size == n) / sum(r.size == n for r in rows)
    assert share(5000) == 1 and abs(sum(r.taken for r in rows) - 0.6 * 13000) <= 3
    assert 2.6 < share(3) / share(1) < 3.4
    # A table where only one size exists: all have the same odds.
    rows = mixing.mix(make(["a b"] * 500), share=0.3).collect()
    assert abs(sum(r.taken for r in rows) - 300) <= 1


def test_bins_grow_with_the_rows(make, monkeypatch):
    texts = ["w " * (i % 17) for i in range(600)]
    few = sorted((r.doc_id, r.taken) for r in mixing.mix(make(texts)).collect())
    monkeypatch.setattr(mixing, "BINS", 1)
    monkeypatch.setattr(mixing, "ROWS", 64)
    assert few == sorted((r.doc_id, r.taken) for r in mixing.mix(make(texts)).collect())


def test_mixed_takes_each_row_for_itself(make):
    """One doc_id in two sources of different sizes: each row has its own copies."""
    docs = make(["a b c"] * 8 + ["d"], ids=[*range(8), 0], source=["x"] * 8 + ["y"])
    want = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    got = [(r.doc_id, r.source) for r in mixing.mixed(docs).collect()]
    assert {k: got.count(k) for k in want} == want


def test_mix_edges(make):
    assert mixing.mix(make(["a"]).limit(0)).count() == 0
    rows = mixing.mix(make(["", None, " "], source=["a", None, "b"])).collect()
    assert {(r.target, r.taken) for r in rows} == {(0.0, 0)}
    copies = mixing.mixed(make(["a b c"] * 6, source=["x"] * 6))
    assert copies.count() == 9 and copies.columns[:3] == ["doc_id", "text", "source"]


def test_no_python_in_the_native_operators(make):
    for frame in (exact.exact_groups(make(["a", "a"])), mixing.mix(make(["a", "b"]))):
        plan = frame._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
