from __future__ import annotations

import datetime as dt
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.plans import catalog as catalogs
from tessera.plans import executor, measure
from tessera.plans.filters import And, Eq, HasEntity, Layout, Not, Or, Overlaps, compile_filter, in_scope, pinned
from tessera.plans.plan import Catalog, DatasetEntry, Keywords, RawMeasure, RawPlan, RulePlanner, plan_question, validate_plan

CATALOG = Catalog(("Eastside",), ("Accounting", "Sales"), ("pdf", "xlsx"), (DatasetEntry("Ledger", "Accounting", "2025-01-01", "2026-03-31", 3, {"post_date": "date", "reference": "text", "credit": "number", "debit": "number"}), DatasetEntry("Notes")))

ROWS = list(itertools.product(["Eastside", "west", None], ["Sales", None], ["2024-08-01", None], ["2024-08-31", None]))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, h, d, "x", "pdf", dt.date.fromisoformat(a) if a else None, dt.date.fromisoformat(b) if b else None, ["Pool", None] if i % 2 else None) for i, (h, d, a, b) in enumerate(ROWS)]
    return spark.createDataFrame(data, "id int, hotel string, department string, dataset string, file_type string, period_start date, period_end date, entities array<string>").cache()


def brute(node, row):
    """SQL's three-valued logic; None is unknown."""
    match node:
        case And(of):
            values = [brute(n, row) for n in of]
            return False if False in values else None if None in values else True
        case Or(of):
            values = [brute(n, row) for n in of]
            return True if not values or True in values else None if None in values else False
        case Not(of):
            inner = brute(of, row)
            return None if inner is None else not inner
        case Eq(field, value):
            have = row[field]
            return None if have is None else have.lower() == value.lower()
        case Overlaps(start, end):
            a, b = row["period_start"], row["period_end"] or row["period_start"]
            return None if a is None and b is None else brute(And((Cmp(None if a is None else str(a) <= end), Cmp(None if b is None else str(b) >= start))), row)
        case Cmp(value):
            return value


class Cmp:
    __match_args__ = ("value",)

    def __init__(self, value):
        self.value = value


LEAVES = st.one_of(st.builds(Eq, st.sampled_from(["hotel", "department"]), st.sampled_from(["EASTSIDE", "west", "sales", "none'; drop"])), st.builds(Overlaps, st.sampled_from(["2024-07-01", "2024-09-01"]), st.sampled_from(["2024-08-15", "2024-12-31"])))
TREES = st.recursive(LEAVES, lambda t: st.one_of(st.lists(t, max_size=3).map(lambda x: And(tuple(x))), st.lists(t, max_size=3).map(lambda x: Or(tuple(x))), t.map(Not)), max_leaves=6)


@settings(max_examples=40, deadline=None)
@given(tree=TREES)
def test_filter_trees_against_brute_force(rows, tree):
    got = {r.id for r in rows.filter(compile_filter(tree)).select("id").collect()}
    assert got == {r.id for r in rows.collect() if brute(tree, r.asDict()) is True}


def test_filter_edges(rows):
    assert rows.filter(compile_filter(And((Or(),)))).count() == len(ROWS) and rows.filter(compile_filter(Not(Or()))).count() == 0
    with pytest.raises(ValueError, match="unknown filter field color"):
        compile_filter(Eq("color", "red"))
    assert rows.filter(compile_filter(HasEntity("pool"))).count() == len(ROWS) // 2
    assert rows.filter(compile_filter(Eq("hotel", "zzz"), skip=frozenset({"hotel"}))).count() == len(ROWS)
    lowered = rows.filter(compile_filter(Eq("hotel", "WEST"), Layout(lowered=frozenset({"hotel"}))))
    assert lowered.count() == 8 and "lower(" not in lowered._jdf.queryExecution().executedPlan().toString().lower()


def test_pins(rows):
    tree = And((Eq("hotel", "Eastside"), Or((Eq("dataset", "x"),)), Not(Eq("hotel", "west"))))
    assert pinned(tree, "hotel") == ["Eastside"] and pinned(tree, "dataset") == []
    assert {r.hotel for r in rows.filter(in_scope(tree)).collect()} == {"Eastside", None}


def test_validation_notes_in_order():
    raw = RawPlan(every=(("hotel", "eastside "), ("hotel", "Atlantis")), any_of_periods=(("2024-08", "2024-08"), ("soon", "later")), exclude=(("department", "Moon"), ("department", "sales")))
    plan, notes = validate_plan(raw, CATALOG)
    assert plan.filter == And((Eq("hotel", "Eastside"), Or((Overlaps("2024-08-01", "2024-08-31"),)), Not(Or((Eq("department", "Sales"),)))))
    assert notes == [
        'No hotel called "Atlantis" in the knowledge base; searched without that filter.',
        'Could not read the period "soon" to "later"; searched all dates.',
        'No department called "Moon" in the knowledge base; ignored that exclusion.',
    ]


def test_measures_are_checked():
    raw = RawPlan("numeric", measure=RawMeasure("ledger", "sum", "credit", (("reference", "ama"), ("nope", "x"), ("reference", " ")), ("year", "month")), answer_shape="table")
    plan, notes = validate_plan(raw, CATALOG)
    assert (plan.measure.dataset, plan.measure.group_by, plan.measure.where_text) == ("Ledger", "year", (("reference", "ama"),))
    assert notes == ["Some text conditions named columns that do not exist and were ignored."]
    for bad, note in ((RawMeasure("Notes", "sum", "x"), "No spreadsheet data"), (RawMeasure("Ledger", "sum", "reference"), '"reference" is not a number column in Ledger')):
        plan, notes = validate_plan(RawPlan("numeric", measure=bad), CATALOG)
        assert plan.measure is None and plan.intent == "doc_question" and plan.answer_shape == "answer+quotes" and notes[0].startswith(note)


def test_planner_fails_twice_then_falls_back():
    class Broken:
        calls = 0

        def plan(self, question, catalog, today):
            self.calls += 1
            raise ValueError("no")

    broken = Broken()
    raw, notes = plan_question(broken, "why", CATALOG, "2026-01-01")
    assert broken.calls == 2 and raw.semantic == ("why",) and len(notes) == 1
    raw, _ = plan_question(RulePlanner(), "Ledger files of Eastside in 2024-08 and last month", CATALOG, "2026-03-05")
    assert raw.intent == "find_files" and ("hotel", "Eastside") in raw.every and raw.any_of_periods == (("2024-08", "2024-08"), ("2026-02-01", "2026-02-28"))


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tidy")
    files = []
    for i, (month, credits) in enumerate((("2026-01", (10.0, 20.0)), ("2026-02", (5.0,)), ("2025-01", (7.0,)))):
        first = dt.date.fromisoformat(f"{month}-03")
        data = [(first, "Vendor AMAZON x", c) for c in credits] + [(first, "Vendor B", 500.0)]
        path = str(root / month)
        spark.createDataFrame(data, "post_date date, reference string, credit double").write.parquet(path)
        files.append((i, i, "Ledger", "Accounting", first.replace(day=1), first.replace(day=28), path))
    columns = [("post_date", "date"), ("reference", "text"), ("credit", "number")]
    datasets = spark.createDataFrame([(*f[:4], "Eastside", "xlsx", *f[4:], columns) for f in files], "id long, document_id long, dataset string, department string, hotel string, file_type string, period_start date, period_end date, path string, columns array<struct<name: string, type: string>>")
    texts = ["The pool was warm and clean in August", "Guests liked the pool and the bar", "Boiler log: the boiler failed twice"]
    documents = spark.createDataFrame([(*f[:1], f"f{f[0]}.xlsx", None, "indexed", "Eastside", *f[3:4], *f[2:3], "xlsx", f[4], f[5]) for f in files], "id long, name string, web_url string, status string, hotel string, department string, dataset string, file_type string, period_start date, period_end date")
    sections = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id long, text string, heading string")
    from tessera.functions.embedders import hashed_words

    chunks = spark.createDataFrame([(10 + i, i, i, None, t, hashed_words(t), "Eastside", "Accounting", "Ledger", "xlsx", files[i][4], files[i][5]) for i, t in enumerate(texts)], "id long, section_id long, document_id long, page int, text string, embedding array<float>, hotel string, department string, dataset string, file_type string, period_start date, period_end date")
    corrections = spark.createDataFrame([(1, "The pool was closed in August", "ann", "global", "approved", None, None, hashed_words("pool August"))], "id long, text string, author string, scope string, status string, hotel string, dataset string, embedding array<float>")
    return executor.Warehouse(spark, documents, sections, chunks, datasets, hashed_words, 3, corrections)


def test_callers_see_their_scope_and_reranked_passages(warehouse):
    from dataclasses import replace

    from tessera.plans.filters import Eq, Not

    raw = RawPlan(semantic=("pool or boiler",))
    turned = replace(warehouse, rerank=lambda question, texts: [float("bar" in t) for t in texts])
    out = executor.run_query(turned, Fixed(raw), "pool")
    assert out["passages"][0]["file"] == "f1.xlsx" and len(out["passages"]) == 3
    hidden = replace(warehouse, scope=Not(Eq("hotel", "eastside")))
    assert executor.run_query(hidden, Fixed(raw), "pool")["passages"] == []
    measure = RawPlan("numeric", any_of_periods=(("2026", "2026"),), measure=RawMeasure("Ledger", "sum", "credit"))
    assert "answer_data" not in (out := executor.run_query(hidden, Fixed(measure), "sum")) or out["answer_data"] == []


class Fixed:
    def __init__(self, raw):
        self.raw = raw

    def plan(self, question, catalog, today):
        return self.raw


def test_measure_end_to_end(warehouse):
    raw = RawPlan("numeric_compare", any_of_periods=(("2026-01", "2026-03"), ("2025-01", "2025-03")), measure=RawMeasure("ledger", "sum", "credit", (("reference", "amazon"),), ("year",)), answer_shape="headline+table")
    log = []
    out = executor.run_query(warehouse, Fixed(raw), "compare", log=log.append)
    assert out["answer_data"] == [{"year": 2025, "value": 7.0, "rows": 1}, {"year": 2026, "value": 35.0, "rows": 3}]
    assert out["coverage"]["missing"] == ["2025-02", "2025-03", "2026-03"] and len(out["sources"]) == 3 and out["confidence"] == "medium"
    assert log[0]["rows"] == 2 and log[0]["generation"] == 3
    empty = RawPlan("numeric", any_of_periods=(("2020", "2020"),), measure=RawMeasure("Ledger", "sum", "credit"))
    out = executor.run_query(warehouse, Fixed(empty), "none")
    assert out["answer_data"] == [] and out["confidence"] == "low" and out["notes"][-1].startswith("No matching rows")


def test_retrieval_end_to_end(warehouse):
    raw = RawPlan(keywords=Keywords(must=("pool",), exclude=("boiler",)), semantic=("warm pool",))
    out = executor.run_query(warehouse, Fixed(raw), "How was the pool in August?", user="bob")
    assert {p["file"] for p in out["passages"]} == {"f0.xlsx", "f1.xlsx"} and out["confidence"] == "medium"
    assert [c["id"] for c in out["corrections"]] == [1]
    files = executor.run_query(warehouse, Fixed(RawPlan("find_files", semantic=("boiler",))), "boiler files")
    assert files["files"][0]["file"] == "f2.xlsx" and "passages" not in files
    none = executor.run_query(warehouse, Fixed(RawPlan(keywords=Keywords(must=("o'brien's",)))), "x")
    assert none["passages"] == [] and none["confidence"] == "low"


def test_catalog_snapshot(warehouse):
    found = catalogs.load_catalog(warehouse.documents, warehouse.datasets)
    assert found.hotels == ("Eastside",) and found.datasets[0].files == 3 and found.datasets[0].columns["credit"] == "number"
    assert (found.datasets[0].start, found.datasets[0].end) == ("2025-01-01", "2026-02-28")


def test_trim():
    passages = [{"text": "x" * 3000, "score": i} for i in range(20)]
    out = executor.trim({"passages": passages, "notes": []})
    assert len(out["passages"][0]["text"]) <= 1500 and 1 <= len(out["passages"]) < 20 and out["passages"][0]["score"] == 0 and len(out["notes"]) == 1
    assert len(passages[0]["text"]) == 3000


def test_tidy_files_of_different_schemas(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "n int, t string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2.5, 7)], "n double, extra int").write.parquet(str(tmp_path / "b"))
    got = measure.read_tidy(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert dict(got.dtypes) == {"n": "double", "t": "string", "extra": "int"} and sorted(r.n for r in got.collect()) == [1.0, 2.5]


def test_corrections_name_known_subjects():
    from tessera.plans.plan import extract_correction

    class Says:
        def __init__(self, got):
            self.got = got

        def extract(self, text, catalog):
            return self.got

    out = extract_correction(Says({"fact": " Closed on Monday ", "subject": {"hotel": "EASTSIDE", "dataset": "Nope", "department": None}}), "x", CATALOG)
    assert out["fact"] == "Closed on Monday" and out["subject"] == {"hotel": "Eastside", "dataset": None, "department": None} and len(out["notes"]) == 1
    assert extract_correction(Says({"question": "Which hotel?"}), "x", CATALOG) == {"question": "Which hotel?"}


def test_the_catalog_knows_only_what_the_caller_may_see(warehouse):
    from dataclasses import replace

    seen = []

    class Asked(Fixed):
        def plan(self, question, catalog, today):
            seen.append(catalog)
            return self.raw

    for scope in (And(), Not(Eq("hotel", "eastside"))):
        executor.run_query(replace(warehouse, scope=scope), Asked(RawPlan(semantic=("pool",))), "pool")
    assert seen[0].hotels == ("Eastside",) and seen[0].datasets
    assert seen[1] == Catalog()
