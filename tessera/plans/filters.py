"""Boolean filter trees, compiled to Columns.

Values become literals, never SQL text.  A null column makes a leaf unknown,
and so it stays out under Not as well, as in SQL.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("hotel", "department", "dataset", "file_type")


@dataclass(frozen=True)
class And:
    of: tuple = ()


@dataclass(frozen=True)
class Or:
    of: tuple = ()


@dataclass(frozen=True)
class Not:
    of: object = None


@dataclass(frozen=True)
class Eq:
    """Equality without regard to case."""

    field: str
    value: str


@dataclass(frozen=True)
class Overlaps:
    """The row's period and this one share a day; a missing end is the start."""

    start: str
    end: str


@dataclass(frozen=True)
class HasEntity:
    """One of the row's entities is this one."""

    name: str


Node = And | Or | Not | Eq | Overlaps | HasEntity


@dataclass(frozen=True)
class Layout:
    """Which columns the fields of a tree stand for; `lowered` are kept in lower case, so that a scan can push the test down."""

    columns: dict[str, str] = field(default_factory=lambda: {f: f for f in FIELDS})
    start: str = "period_start"
    end: str = "period_end"
    entities: str = "entities"
    lowered: frozenset[str] = frozenset()


def compile_filter(node: Node, layout: Layout | None = None, skip: frozenset[str] = frozenset()) -> Column:
    """A tree as a condition; an empty And or Or holds; fields in `skip` are taken as true."""
    layout = layout or Layout()
    match node:
        case And(of):
            return reduce(operator.and_, (compile_filter(n, layout, skip) for n in of), F.lit(True))
        case Or(of):
            return reduce(operator.or_, (compile_filter(n, layout, skip) for n in of)) if of else F.lit(True)
        case Not(of):
            return ~compile_filter(of, layout, skip)
        case Overlaps(start, end):
            first = F.col(layout.start)
            return (first <= F.lit(end).cast("date")) & (F.coalesce(F.col(layout.end), first) >= F.lit(start).cast("date"))
        case HasEntity(name):
            return F.exists(layout.entities, lambda e: F.lower(e) == name.lower())
        case Eq(name, value):
            if name in skip:
                return F.lit(True)
            if name not in layout.columns:
                raise ValueError(f"unknown filter field {name}")
            column = F.col(layout.columns[name])
            return (column if layout.columns[name] in layout.lowered else F.lower(column)) == value.lower()
    raise TypeError(f"not a filter: {node!r}")


def dataset_period(start: str | None = None, end: str | None = None) -> Column:
    """Datasets that end from `start` on and begin by `end`, each if given; null periods stay out."""
    tests = [F.col("period_end") >= F.lit(start).cast("date")] if start else []
    tests += [F.col("period_start") <= F.lit(end).cast("date")] if end else []
    return reduce(operator.and_, tests, F.lit(True))


def under(path: Column | str, folder: str | Column) -> Column:
    """Strictly below a folder; signs in names mean themselves."""
    path = F.col(path) if isinstance(path, str) else path
    return F.startswith(path, F.concat(F.lit(folder) if isinstance(folder, str) else folder, F.lit("/")))


def contains_pattern(column: Column | str, needle: str) -> Column:
    """Substring test without case in which % and _ are wildcards and a backslash is itself."""
    column = F.col(column) if isinstance(column, str) else column
    return F.ilike(column, F.lit("%" + needle.replace("\\", "\\\\") + "%"))


def between_any(column: Column | str, periods: list[tuple[str, str]]) -> Column:
    """A date in one of the periods, ends included; no periods hold for all."""
    column = F.col(column) if isinstance(column, str) else column
    tests = [column.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in periods]
    return reduce(operator.or_, tests) if tests else F.lit(True)


def pinned(node: Node, name: str) -> list[str]:
    """Values that a field must have: leaves that only And stands above."""
    match node:
        case And(of):
            return [v for n in of for v in pinned(n, name)]
        case Eq(field_name, value) if field_name == name:
            return [value]
    return []


def in_scope(node: Node, fields: tuple[str, ...] = ("hotel", "dataset")) -> Column:
    """Rows about nothing in particular, or about what the filter pins."""
    tests = []
    for name in fields:
        values = [v.lower() for v in pinned(node, name)]
        tests.append(F.col(name).isNull() | (F.lower(F.col(name)).isin(values) if values else F.lit(True)))
    return reduce(operator.and_, tests, F.lit(True))
