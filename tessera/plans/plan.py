"""From a planner's flat output to a checked plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Protocol

from tessera.functions.dates import normalize_range
from tessera.plans.filters import And, Eq, Node, Not, Or, Overlaps

INTENTS = ("doc_question", "find_files", "numeric", "numeric_compare", "trend")
AGGREGATES = ("sum", "avg", "count", "min", "max")
GROUPS = ("year", "month", "day")


@dataclass(frozen=True)
class Keywords:
    must: tuple[str, ...] = ()
    should: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class RawMeasure:
    dataset: str
    agg: str
    field: str
    where_text: tuple[tuple[str, str], ...] = ()
    group_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class RawPlan:
    """What a planner returns: `every` is AND, `any_of_periods` OR, `exclude` NOT."""

    intent: str = "doc_question"
    every: tuple[tuple[str, str], ...] = ()
    any_of_periods: tuple[tuple[str, str], ...] = ()
    exclude: tuple[tuple[str, str], ...] = ()
    keywords: Keywords = Keywords()
    semantic: tuple[str, ...] = ()
    measure: RawMeasure | None = None
    answer_shape: str = "answer+quotes"


@dataclass(frozen=True)
class Measure:
    dataset: str
    agg: str
    field: str
    where_text: tuple[tuple[str, str], ...] = ()
    group_by: str | None = None


@dataclass(frozen=True)
class Plan:
    intent: str
    filter: Node
    periods: tuple[tuple[str, str], ...] = ()
    keywords: Keywords = Keywords()
    semantic: tuple[str, ...] = ()
    measure: Measure | None = None
    answer_shape: str = "answer+quotes"


@dataclass(frozen=True)
class DatasetEntry:
    name: str
    department: str | None = None
    start: str | None = None
    end: str | None = None
    files: int = 0
    columns: dict[str, str] | None = None


@dataclass(frozen=True)
class Catalog:
    """The values that exist; whatever a filter names has to be one of them."""

    hotels: tuple[str, ...] = ()
    departments: tuple[str, ...] = ()
    file_types: tuple[str, ...] = ()
    datasets: tuple[DatasetEntry, ...] = ()

    def spelled(self, name: str, value: str) -> str | None:
        """A value as the catalog writes it."""
        known = {"hotel": self.hotels, "department": self.departments, "file_type": self.file_types, "dataset": tuple(d.name for d in self.datasets)}[name]
        return next((k for k in known if k.lower() == value.strip().lower()), None)


@dataclass
class _Checked:
    nodes: list = field(default_factory=list)
    notes: list = field(default_factory=list)


def _known(catalog: Catalog, pairs: tuple[tuple[str, str], ...], consequence: str, out: _Checked) -> list[Eq]:
    found = []
    for name, value in pairs:
        spelled = catalog.spelled(name, value)
        if spelled is None:
            out.notes.append(f'No {name.replace("_", " ", 1)} called "{value}" in the knowledge base; {consequence}')
        else:
            found.append(Eq(name, spelled))
    return found


def _measure(raw: RawMeasure, catalog: Catalog, notes: list[str]) -> Measure | None:
    entry = next((d for d in catalog.datasets if d.name.lower() == raw.dataset.lower()), None)
    if entry is None or entry.columns is None:
        notes.append(f'No spreadsheet data for "{raw.dataset}", so nothing could be calculated; showing matching documents instead.')
        return None
    if raw.agg != "count" and entry.columns.get(raw.field) != "number":
        notes.append(f'"{raw.field}" is not a number column in {entry.name}; showing matching documents instead.')
        return None
    usable = tuple((c, text) for c, text in raw.where_text if entry.columns.get(c) == "text" and text.strip())
    if len(usable) < len(raw.where_text):
        notes.append("Some text conditions named columns that do not exist and were ignored.")
    return Measure(entry.name, raw.agg, raw.field, usable, raw.group_by[0] if raw.group_by else None)


def validate_plan(raw: RawPlan, catalog: Catalog) -> tuple[Plan, list[str]]:
    """The plan with catalog spellings and exact periods, and notes on what was dropped, in order."""
    out = _Checked()
    out.nodes += _known(catalog, raw.every, "searched without that filter.", out)
    periods = []
    for start, end in raw.any_of_periods:
        exact = normalize_range(start, end)
        if exact is None:
            out.notes.append(f'Could not read the period "{start}" to "{end}"; searched all dates.')
        else:
            periods.append(exact)
    if periods:
        out.nodes.append(Or(tuple(Overlaps(a, b) for a, b in periods)))
    if excluded := _known(catalog, raw.exclude, "ignored that exclusion.", out):
        out.nodes.append(Not(Or(tuple(excluded))))
    plan = Plan(raw.intent, And(tuple(out.nodes)), tuple(periods), raw.keywords, tuple(s.strip() for s in raw.semantic if s.strip()), None, raw.answer_shape)
    if raw.measure is not None:
        measure = _measure(raw.measure, catalog, out.notes)
        plan = replace(plan, measure=measure) if measure else replace(plan, intent="doc_question", answer_shape="answer+quotes")
    return plan, out.notes


class Planner(Protocol):
    def plan(self, question: str, catalog: Catalog, today: str) -> RawPlan: ...


def plan_question(planner: Planner, question: str, catalog: Catalog, today: str) -> tuple[RawPlan, list[str]]:
    """The planner's output; after two failures a plain document search and a note."""
    for _ in range(2):
        try:
            return planner.plan(question, catalog, today), []
        except Exception as error:  # a planner may fail in any way
            last = error
    return RawPlan(semantic=(question,)), [f"The question could not be planned ({type(last).__name__}); searched all documents instead."]


class RulePlanner:
    """A planner without a model: catalog names found in the question, and years or months as periods."""

    def plan(self, question: str, catalog: Catalog, today: str) -> RawPlan:
        import datetime as dt
        import re

        from tessera.functions.dates import resolve_relative

        text = question.lower()
        every = tuple((name, value) for name, values in (("hotel", catalog.hotels), ("department", catalog.departments), ("dataset", tuple(d.name for d in catalog.datasets))) for value in values if re.search(rf"\b{re.escape(value.lower())}\b", text))
        spans = [(m, m) for m in re.findall(r"\b20\d{2}(?:-\d{2}){0,2}\b", text)]
        for phrase in ("last month", "this month", "last year", "this year", "year to date", "yesterday", "today"):
            if phrase in text and (span := resolve_relative(phrase, dt.date.fromisoformat(today))):
                spans.append(span)
        return RawPlan(intent="find_files" if re.search(r"\bfiles?\b", text) else "doc_question", every=every, any_of_periods=tuple(spans), semantic=(question,))


def check_subject(catalog: Catalog, subject: dict[str, str | None]) -> tuple[dict[str, str | None], list[str]]:
    """A correction's subject in the catalog's spelling; what the catalog lacks is dropped with a note."""
    out, notes = {}, []
    for name, value in subject.items():
        spelled = catalog.spelled(name, value) if value else None
        if value and spelled is None:
            notes.append(f'No {name.replace("_", " ", 1)} called "{value}" in the knowledge base; left it out.')
        out[name] = spelled
    return out, notes


class Extractor(Protocol):
    def extract(self, text: str, catalog: Catalog) -> dict: ...


def extract_correction(extractor: Extractor, text: str, catalog: Catalog) -> dict:
    """{fact, subject, notes} of what a user said, or {question} where it was not clear."""
    got = extractor.extract(text, catalog)
    if not got.get("fact"):
        return {"question": got.get("question") or "What should be corrected?"}
    subject, notes = check_subject(catalog, got.get("subject", {}))
    return {"fact": got["fact"].strip(), "subject": subject, "notes": notes}
