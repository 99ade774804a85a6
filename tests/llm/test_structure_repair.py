from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm import structure_repair as sr
from tessera.llm.common import drop_written

SCHEMA = "conv_id long, turn int, role string, text string, n string, at double"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SHAPE = re.compile(r"(s?(ua)+)?")
FULL = re.compile(r"[^\x20\x09-\x0D]")


def broken(rows):
    """conv_id: rows (turn, role, text) after the damage."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out[c] += []
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out[c] += [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        full = FULL.findall(text)
        out.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by Dijkstra's least (cost, then letters) from the end, over all (row, roles so far) shapes."""
    given = faults(rows)
    best = {}  # (row, state) -> (cost, letters, repaired); a state is the role initials that still matter

    def rest(i, state, inserted=0):
        key = (i, state, inserted)
        if key not in best:
            found = []
            if i == len(rows):
                if state in ("", "a"):
                    found.append((0, "", ()))
            else:
                _, role, text = rows[i]
                more = 3 * (given[i] == "truncated")
                c, x, r = rest(i + 1, state)
                found.append((c + 4, "D" + x, r))
                if given[i] not in ("blank", "duplicate"):
                    for letter, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                        if after(state, name[:1]):
                            c, x, r = rest(i + 1, name[:1])
                            found.append((c + price + more, letter + x, (f"{name}:{text}", *r)))
            if inserted < 3:
                for name in ("user", "assistant"):
                    if after(state, name[:1]):
                        c, x, r = rest(i, name[:1], inserted + 1)
                        found.append((c + 3, "I" + x, (f"{name}:", *r)))
            best[key] = min(found, default=(1 << 40, "", ()))
        return best[key]

    def after(state, initial):
        return (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    for i in range(len(rows), -1, -40):
        rest(i, "")
    return rest(0, "")


def plainly(rows):
    out = []
    for c, own in broken(rows).items():
        given, turns = faults(own), [t for t, _, _ in own if t is not None]
        cost, audit, repaired = cheapest(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        assert SHAPE.fullmatch("".join(x[0] for x in repaired))
        out.append((c, gaps, given.count("blank"), given.count("duplicate"), given.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, parts=3):
    given = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r[c] for c in COLUMNS) for r in sr.repaired(given).collect()]
    assert sorted(got, key=repr) == plainly(rows)
    drop_written(spark)


def drawn(seed, sizes, roles=("user", "assistant", "system"), texts=("a.", "b", "c!", "", " ")):
    draw = random.Random(seed)
    return [(c, t, draw.choice(roles), draw.choice(texts) + (f" {t}." if draw.random() < 0.6 else "")) for c, n in enumerate(sizes) for t in range(n)]


def test_many_short_ones(spark):
    check(spark, drawn(1, [n % 9 for n in range(300)]))


def test_roles_that_fit_nowhere(spark):
    check(spark, drawn(2, [6] * 60, roles=("user", "assistant", "system", "tool", "", " ", "Übung", "unit")))


def test_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sr, "BLOCK", 3)
    check(spark, drawn(3, [120, 1, 7, 90, 2, 2, 61]))
    monkeypatch.setattr(sr, "CHARACTERS", 1)
    check(spark, drawn(4, [25, 1, 7]))


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x."), (1, None, "user", "é ́."), (1, 5, "assistant", "ok?"), (2, None, None, "z"), (-3, 2, "user", "w. " * 40_000), (-3, 9, "assistant", "v " * 40_000)]
    rows += [(4, 1, "user", "same.")] * 30 + [(4, 2, "user", "same."), (4, 2, "assistant", "end."), (4, 2, "assistant", "end.")]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(20, t, "user", "x.") for t in range(60) if zlib.crc32(f"20:{t}".encode()) % 20 == 0]])
def test_no_rows_left(spark, rows):
    check(spark, rows)
