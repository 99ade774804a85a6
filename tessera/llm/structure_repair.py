"""Repair of the structure of damaged conversations at least cost.

A conversation is a sequence of rows, and its role initials shall read
``(s?(ua)+)?``.  Four states follow that pattern: nothing yet, after s, after u,
after a.  Edits are arcs between (row, state) nodes.  Minimum costs from the
front (`front`) and to the end (`rest`) show the arcs of all cheapest repairs:
those whose two costs and own cost add up to the whole.  From the set of nodes
reached so far, the walk takes at each step the least letter that any such arc
bears; that gives the cheapest repair whose letters are ASCII-least.

Rows are counted by (conversation, turn, role, text), so that repeated ones are
one row with a number, and are sorted by range.  A task repairs every
conversation that it holds whole.  What may go on in another part, or has more
than BLOCK rows, leaves as blocks with the costs between the four states at
their two ends; those 4 x 4 tables give each block the costs to the end behind
it, and the blocks are then walked in order, one at a time.

Defined results: a null role or text is one space, as is a null turn or conv_id
in the key of the damage.  Rows are taken by turn, nulls first, then by role and
text.  A null conv_id is a conversation of its own.  A role without characters
has no initial: it fits nowhere.  Of the rows that repeat role and text the one
of the least turn is the first.  An empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import parts_for, released, written
from tessera.llm.pieces import ROWS, batched

#: Rows of a block, and characters of its texts after which it ends.
BLOCK, CHARACTERS = 4096, 1 << 22
#: What conversations are sorted by range with; a key of bounded size.
PREFIX = 64
BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the next user or assistant row leads to, and that row's initial.
NEXT = (USER, USER, ASSISTANT, USER)
WANTED = ("u", "u", "a", "u")
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
INF = 1 << 62

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
DONE = [(c, pa.int64()) for c in ("conv_id", *COUNTS)] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("again", pa.bool_())])
OPEN = [("at", pa.int64()), ("between", pa.list_(pa.int64())), ("rows", pa.list_(ROW))]
SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
OPEN_SCHEMA = SCHEMA + ", at long, between array<long>, rows array<struct<turn: long, role: string, text: string, n: long, again: boolean>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: distinct rows after the damage and how often each is there."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return rows.filter("fault > 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """The rows with `again`: whether role and text were there in an earlier turn."""
    key = F.xxhash64(F.lit(1), "role", F.lit(0), "text"), F.xxhash64(F.lit(2), "role", F.lit(0), "text")
    rows = written(rows.withColumns({"key_a": key[0], "key_b": key[1]}), "rows")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv_id", "key_a", "key_b").agg(F.min(turn).alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("key_a").alias("a"), F.col("key_b").alias("b"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key_a") == F.col("a")) & (F.col("key_b") == F.col("b"))
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "n", F.coalesce(turn > F.col("first"), F.lit(False)).alias("again"))


@functools.cache
def edits(initial: str, forced: bool, more: int) -> tuple[list[tuple[str, int, int]], ...]:
    """For each state the edits of a row as (letter, next state, cost); one that stays costs `more`."""
    out: tuple[list[tuple[str, int, int]], ...] = ([], [], [], [])
    for state, arcs in enumerate(out):
        arcs.append(("D", state, DELETE))
        if not forced:
            if initial == WANTED[state]:
                arcs.append(("K", NEXT[state], more))
            elif initial == "s" and state == START:
                arcs.append(("K", SYSTEM, more))
            arcs.append(("R", NEXT[state], REROLE + more))
    return out


class Row:
    """A row of a conversation with what its repair needs."""

    __slots__ = ("again", "blank", "cut", "initial", "moves", "n", "role", "text", "turn")

    def __init__(self, turn: int | None, role: str, text: str, n: int, again: bool) -> None:
        seen = text.rstrip(BLANKS)
        self.turn, self.role, self.text, self.n, self.again = turn, role, text, n, again
        self.initial = role[:1]
        self.blank = not seen
        self.cut = bool(seen) and seen[-1] not in ".!?"
        self.moves = edits(self.initial if self.initial in "uas" else "", self.blank or again, TRUNCATED if self.cut else 0)


def settled_front(costs: list[int]) -> list[int]:
    """Least costs once rows may be inserted here."""
    out = list(costs)
    for state in (START, SYSTEM, USER, ASSISTANT):
        out[NEXT[state]] = min(out[NEXT[state]], out[state] + INSERT)
    return out


def settled_rest(costs: list[int]) -> list[int]:
    out = list(costs)
    for state in (USER, ASSISTANT, USER, START, SYSTEM):
        out[state] = min(out[state], out[NEXT[state]] + INSERT)
    return out


#: Costs before the first row, and behind the last: the pattern ends with nothing or an a.
FRONT = settled_front([0, INF, INF, INF])
REST = settled_rest([0, INF, INF, 0])


def forward(rows: list[Row], front: list[int]) -> list[list[int]]:
    """Least costs of every state before each row and behind the last."""
    out = [front]
    for row in rows:
        costs = [INF] * 4
        for state in range(4):
            if out[-1][state] < INF:
                for _, to, cost in row.moves[state]:
                    costs[to] = min(costs[to], out[-1][state] + cost + DELETE * (row.n - 1))
        out.append(settled_front(costs))
    return out


def backward(rows: list[Row], rest: list[int]) -> list[list[int]]:
    """Least costs from every state before each row, and behind the last, to the end."""
    out = [rest]
    for row in reversed(rows):
        costs = [min(cost + out[-1][to] for _, to, cost in row.moves[state]) + DELETE * (row.n - 1) for state in range(4)]
        out.append(settled_rest(costs))
    return out[::-1]


def between(rows: list[Row]) -> list[int]:
    """The 16 least costs from each state before the rows to each behind them."""
    out: list[int] = []
    for state in range(4):
        out += forward(rows, settled_front([0 if s == state else INF for s in range(4)]))[-1]
    return [min(x, INF) for x in out]


class Repair:
    """A conversation as its blocks pass by."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns: tuple[int, int, int] | None = None
        self.last: str | None = None
        self.front, self.nodes = FRONT, {START}
        self.letters: list[str] = []
        self.sha, self.begun = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        if self.begun:
            self.sha.update(b"\n")
        self.begun = True
        self.sha.update(f"{role}:{text}".encode())

    def count(self, row: Row) -> None:
        c = self.counts
        if row.blank:
            c["blank"] += row.n
        else:
            c["duplicate"] += row.n - (not row.again)
            c["truncated"] += row.cut and not row.again
        c["illegal"] += (self.last is not None and self.last + row.initial not in LEGAL) + (row.n - 1)
        self.last = row.initial
        if row.turn is not None:
            low, high, n = self.turns or (row.turn, row.turn, 1)
            self.turns = low, row.turn, n + (row.turn != high)

    def step(self, arcs: list[tuple[str, int, int]]) -> tuple[str, set[int], int]:
        """The least letter of the arcs (letter, state, next state), where it leads, and one state that it leaves from."""
        letter = min(x for x, _, _ in arcs)
        taken = [(state, to) for x, state, to in arcs if x == letter]
        return letter, {to for _, to in taken}, taken[0][0]

    def feed(self, rows: list[Row], rest: list[int]) -> None:
        """The next rows; `rest` are the least costs from behind them to the end."""
        front, back = forward(rows, self.front), backward(rows, rest)
        total = min(f + b for f, b in zip(front[0], back[0], strict=True))
        for i, row in enumerate(rows):
            self.count(row)
            more = DELETE * (row.n - 1)
            while True:
                inserts = [("I", s, NEXT[s]) for s in self.nodes if front[i][s] + INSERT + back[i][NEXT[s]] == total]
                own = [(x, s, to) for s in self.nodes for x, to, cost in row.moves[s] if front[i][s] + cost + more + back[i + 1][to] == total]
                letter, self.nodes, state = self.step(inserts + own)
                self.letters.append(letter)
                if letter == "I":
                    self.put(ROLES[NEXT[state]], "")
                    continue
                if letter != "D":
                    self.put(row.role if letter == "K" else ROLES[NEXT[state]], row.text)
                self.letters.append("D" * (row.n - 1))
                break
        self.front = front[-1]

    def result(self, conv_id: int | None) -> tuple:
        """The row of the conversation, behind whose last row users and assistants may still be missing."""
        total = min(f + r for f, r in zip(self.front, REST, strict=True))
        while not any(self.front[s] == total and s in (START, ASSISTANT) for s in self.nodes):
            letter, self.nodes, state = self.step([("I", s, NEXT[s]) for s in self.nodes if self.front[s] + INSERT + REST[NEXT[s]] == total])
            self.letters.append(letter)
            self.put(ROLES[NEXT[state]], "")
        self.counts["cost"] = total
        if self.turns:
            low, high, n = self.turns
            self.counts["gaps"] = high - low + 1 - n
        return (conv_id, *(self.counts[c] for c in COUNTS), "".join(self.letters), self.sha.hexdigest())


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bool, bool, list[Row]]]:
    """(conv_id, at, whether it begins, whether it ends here, rows) of sorted rows; a part's first and last conversation may go on elsewhere."""
    conv, rows, size, begins, first, at = None, [], 0, False, True, 0
    for batch in batches:
        for conv_id, *given, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (conv_id != conv or len(rows) >= BLOCK or size >= CHARACTERS):
                yield conv, at, begins and not first, conv_id != conv, rows
                begins, first = conv_id != conv, first and conv_id == conv
                rows, size = [], 0
            if not rows:
                conv, at = conv_id, number
            rows.append(Row(*given))
            size += len(given[2])
    if rows:
        yield conv, at, begins and not first, False, rows


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    parts = parts_for(conversations, factor=1)
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    rows = written(marked(damaged(conversations)), "marked")
    rows = rows.repartitionByRange(parts, *by, F.left("text", F.lit(PREFIX)).asc()).sortWithinPartitions(*by, F.col("text").asc()).withColumn("at", F.monotonically_increasing_id())
    none = (None,) * len(OPEN)

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, at, begins, ends, own in blocks(batches):
            if begins and ends:
                repair = Repair()
                repair.feed(own, REST)
                yield repair.result(conv_id) + none
            else:
                yield (conv_id, *(None,) * (len(DONE) - 1), at, between(own), [dict(turn=r.turn, role=r.role, text=r.text, n=r.n, again=r.again) for r in own])

    found = written(_mapped(rows.select("conv_id", "turn", "role", "text", "n", "again", "at"), sorted_out, [*DONE, *OPEN], OPEN_SCHEMA), "repaired")
    done = found.filter("at is null").select(*[n for n, _ in DONE])
    return _completed(conversations, done.unionByName(_walked(found.filter("at is not null").select("conv_id", "at", "between", "rows"))))


def _mapped(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], fields: list, schema: str) -> DataFrame:
    arrow = pa.schema(fields)

    @released
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Open blocks are few, but large.
        yield from batched(make(batches), arrow, 64 if len(fields) > len(DONE) else ROWS)

    return rows.mapInArrow(task, schema)


def _walked(open_blocks: DataFrame) -> DataFrame:
    """The results of conversations in blocks (conv_id, at, between, rows)."""

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv_id, at, costs to the end behind the block), the last block first."""
        conv, rest = object(), REST
        for batch in batches:
            for conv_id, at, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != conv:
                    conv, rest = conv_id, REST
                yield conv_id, at, rest
                rest = [min(min(costs[4 * s + to] + rest[to] for to in range(4)), INF) for s in range(4)]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, repair = None, None
        for batch in batches:
            for conv_id, own, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if repair is None or conv_id != conv:
                    if repair is not None:
                        yield repair.result(conv)
                    conv, repair = conv_id, Repair()
                repair.feed([Row(r["turn"], r["role"], r["text"], r["n"], r["again"]) for r in own], rest)
        if repair is not None:
            yield repair.result(conv)

    slim = open_blocks.select("conv_id", "at", "between").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", F.col("at").desc())
    behind = _mapped(slim, rests, [("conv_id", pa.int64()), ("at", pa.int64()), ("rest", pa.list_(pa.int64()))], "conv_id long, at long, rest array<long>")
    joined = open_blocks.drop("between").join(behind.drop("conv_id"), "at")
    # One block at a time: a batch of one row holds BLOCK rows at most.
    ordered = joined.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "at").select("conv_id", "rows", "rest")
    return _mapped(ordered, results, DONE, SCHEMA)


def _completed(conversations: DataFrame, done: DataFrame) -> DataFrame:
    """Those of which no row is left, too."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    empty: dict[str, Column] = {c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS}
    empty |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return ids.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left").withColumns(empty).withColumn("conv_id", F.col("id")).select(*[n for n, _ in DONE])
