from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie
from tessera.llm.common import drop_written

SCHEMA = "conv_id long, turn int, role string, text string, depth double, at string, rank boolean"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plainly(rows):
    """The contract, word for word: rows of (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append((t is not None, t or 0, digest, role, text))
    for own in turns.values():
        own.sort()
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c > 0 else -1))
        made[c] = tuple((r, t) for *_, r, t in [*turns.get(base, [])[:h], *own[h:]])
    members, ends = defaultdict(list), defaultdict(list)
    for c, whole in made.items():
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, own in members.items():
        cost = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += cost
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(own), len(n), min(members[n[:-1]]) if n else None, len(own), kids[n], leaves[n], saved[n], sha(ends[n])) for n, own in members.items())


def check(spark, rows):
    given = spark.createDataFrame([(*r, 0.5, "x", True) for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(given).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == sorted(plainly(rows), key=repr)
    by_place = sorted(got, key=lambda r: r["preorder"])
    assert [r["preorder"] for r in by_place] == list(range(1, len(got) + 1))
    for r in got:  # a subtree is an interval: it ends before the next node that is no deeper
        inside = by_place[r["preorder"] : r["subtree_end"]]
        assert all(x["depth"] > r["depth"] for x in inside)
        after = by_place[r["subtree_end"] : r["subtree_end"] + 1]
        assert all(x["depth"] <= r["depth"] for x in after)
    drop_written(spark)


def test_forests_of_few_texts(spark):
    draw = random.Random(3)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a b", "c", ""])) for c in range(90) for t in range(draw.randrange(1, 6))]
    check(spark, rows)


def test_long_conversations_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 2)
    draw = random.Random(4)
    long = [("user" if t % 2 else "assistant", draw.choice("xy")) for t in range(40)]
    rows = [(c, t, *(long[t] if t < cut else ("user", draw.choice("xyz")))) for c, cut in enumerate([40, 40, 39, 27, 3, 30, 12, 9, 4, 1] * 3) for t in range(cut + c % 3)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "left out"), (0, None, None, None), (0, 1, "user", "x " * 50_000), (0, 1, "user", "x " * 50_000), (0, 1, "assistant", None), (1, 0, "", "a"), (1, 0, "a", "")]
    rows += [(20, 3, "user", "é ́"), (-7, 1, "user", "n"), (-7, 2, "user", "m"), (-20, 0, "user", "p"), (-20, 0, "user", "p"), (39, 0, "user", "only")]
    # One conversation of which most others are copies.
    rows += [(c, t, "user", f"hot {t}") for c in range(100, 400) for t in range(5)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_rows(spark, rows):
    given = spark.createDataFrame([(*r, 0.5, "x", True) for r in rows], SCHEMA)
    assert prefix_trie.prefix_trie(given).collect() == []
