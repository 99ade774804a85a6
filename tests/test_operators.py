from __future__ import annotations

import datetime as dt
import random
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunk, generations, profile, search, sheets, state

# Sheets


def grid(spark, rows, doc="d", sheet="s"):
    cells = [(doc, sheet, i, j, str(v)) for i, r in enumerate(rows) for j, v in (r.items() if isinstance(r, dict) else enumerate(r)) if v is not None]
    return spark.createDataFrame(cells, "doc_id string, sheet string, row int, col int, s string")


LEDGER = [
    {5: "Property"},
    {5: "General Ledger Activity Detail"},
    {5: "From 8/1/2026 to 8/31/2026 for Ledger Accounts 10000 to 99999"},
    {0: "Account #", 5: "Account Name"},
    {1: "Post Date", 2: "Invoice ", 6: "Reference", 8: "Detail Description", 10: "Debit", 12: "Credit", 13: "JEID", 14: "Invoice No", 16: "Source"},
    {1: "10050.000", 5: "Operating Account"},
    {1: "8/1/2026", 6: "Card Daily Report", 8: "Card Deposit", 10: "1,632.98", 13: "2026-08-0041", 16: "CMDP"},
    {},
    {1: "8/1/2026", 6: "Manual Vendor A", 12: "54.98", 13: "2026-08-0969", 16: "PWOD"},
    {5: "Total 10050.000", 10: "1,632.98", 12: "54.98"},
    {1: "10200.000", 5: "Guest Ledger's Clearing"},
    {1: "8/2/2026", 6: "Deposit Daily Report", 8: "Cash Deposit", 10: "652.21", 13: "2026-08-0043", 16: "CMDP"},
]


def test_ledger(spark):
    cells = grid(spark, LEDGER)
    rows = sheets.ledger(cells).orderBy("row").collect()
    assert [(r.account, r.account_name) for r in rows] == [("10050.000", "Operating Account")] * 2 + [("10200.000", "Guest Ledger's Clearing")]
    assert [r.debit for r in rows] == [1632.98, None, 652.21] and [r.credit for r in rows] == [None, 54.98, None]
    assert [str(r.post_date) for r in rows] == ["2026-08-01", "2026-08-01", "2026-08-02"] and rows[1].reference == "Manual Vendor A" and rows[0].jeid == "2026-08-0041"
    period = sheets.ledger_period(cells).head()
    assert (str(period.start), str(period.end)) == ("2026-08-01", "2026-08-31")
    assert sheets.normalizer(cells).head().normalizer == "ledger"


def test_many_ledger_rows(spark):
    rows = [*LEDGER[:6], *[{1: "8/1/2026", 6: f"r{i}", 10: "1.00"} for i in range(15_000)]]
    assert sheets.ledger(grid(spark, rows)).agg(F.sum("debit")).head()[0] == 15_000.0


TRACKER = [["Tracker"], ["Room #", "Status", "Cost", None, "Done On"], [101, "Done", "1,200", None, "8/1/2026"], [], [102, "Open", "(50.00)", None, None]]


def test_generic_tracker(spark):
    table = sheets.tidy_table(grid(spark, TRACKER), "d", "s")
    assert dict(table.dtypes) == {"room": "double", "status": "string", "cost": "double", "done_on": "date"}
    assert [tuple(r) for r in table.collect()] == [(101.0, "Done", 1200.0, dt.date(2026, 8, 1)), (102.0, "Open", -50.0, None)]
    assert sheets.normalizer(grid(spark, TRACKER)).head().normalizer == "generic"


def test_repeated_and_missing_headings(spark):
    table = sheets.tidy_table(grid(spark, [["Amount", "Amount", None], [1, 2, "x"], [3, 4, "y"]]), "d", "s")
    assert table.columns == ["amount", "amount_2", "col_3"] and table.count() == 2


def test_header_detection(spark):
    assert sheets.header_rows(grid(spark, [["Title"], [], ["A", "B"], [1, 2]])).head().header == 2
    assert sheets.header_rows(grid(spark, [[1, 2], [3, 4]])).count() == 0


def test_description_and_sections(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2026, 8, 1), "Manual Vendor A", 54.98), (dt.date(2026, 8, 3), "O'Brien's Supply", 12.5)], "post_date date, reference string, credit double")
    types = {"post_date": "date", "reference": "text", "credit": "number"}
    text = sheets.describe(rows, types, "f.xlsx", "S", "Ledger", "post_date").head().description
    assert text.split("\n")[:3] == ['Spreadsheet "f.xlsx", sheet "S" (Ledger).', "2 rows. Columns: post_date (date), reference (text), credit (number).", "Dates from 2026-08-01 to 2026-08-03."]
    assert "- post_date: 2026-08-01; reference: Manual Vendor A; credit: 54.98" in text
    many = spark.range(60).withColumn("v", F.col("id") * 2)
    parts = sheets.row_sections(many, ["id", "v"], "S", "id").collect()
    assert [p.heading for p in parts] == ["S rows 1-25", "S rows 26-50", "S rows 51-60"] and parts[0].text.startswith("id: 0; v: 0\n")
    assert sheets.row_sections(spark.range(201), ["id"], "S", "id").count() == 0
    path = str(tmp_path / "it's")
    sheets.write_tidy(rows, path)
    assert spark.read.parquet(path).agg(F.round(F.sum("credit"), 2), F.count("*")).head() == (67.48, 2)
    with pytest.raises(ValueError, match="needs rows"):
        sheets.write_tidy(rows.limit(0), path)


# Chunks


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=30), min_size=1, max_size=400))
def test_windows_cover_all_words(words):
    text = " ".join(words)
    out = chunk.word_windows(text, 20, 0.15)
    assert out[0].split() == words[: len(out[0].split())] and out[-1].split() == words[len(words) - len(out[-1].split()) :]
    if len(out) > 1:
        assert all(chunk.estimate(w) <= 20 or len(w.split()) == 1 for w in out)
    at = 0
    for w in out:
        part = w.split()
        start = next(k for k in range(at, -1, -1) if words[k : k + len(part)] == part)
        assert start <= at
        at = start + len(part)
    assert at == len(words)


def test_chunk_documents(spark):
    table = "\n".join(["| a | b |", "| --- | --- |", *[f"| {i} | x |" for i in range(400)]])
    prose = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, 0, "H", 1, "Short text."), (2, 0, None, None, prose), (3, 0, "T", 1, table), (4, 0, "Same", 1, "one"), (4, 1, "Same", 2, "two"), (5, 0, None, None, "")]
    got = chunk.chunk_documents(spark.createDataFrame(rows, "doc int, ord int, heading string, page int, text string"), "doc").collect()
    of = lambda d: sorted((r for r in got if r.doc == d), key=lambda r: (r.parent, r.child))
    assert [(r.text, r.tokens, r.parent_text) for r in of(1)] == [("Short text.", 3, "Short text.")]
    assert all(r.tokens <= 201 for r in of(2)) and max(chunk.estimate(r.parent_text) for r in of(2)) <= 1500 and len({r.parent for r in of(2)}) > 1
    assert all(r.text.startswith("| a | b |\n| --- | --- |\n") for r in of(3)) and sum(r.text.count("\n") - 1 for r in of(3)) == 400
    assert [(r.page_from, r.page_to, r.parent) for r in of(4)] == [(1, 2, 0), (1, 2, 0)] and not of(5)


def test_parents_by_pointers_are_those_of_a_walk(spark):
    import random

    import pandas as pd

    draw, small = random.Random(8), chunk.Sizes(20, 40, 8, 0.15, 6)
    rows = []
    for doc in [None, *range(12)]:
        for place in range(draw.choice([1, 3, 40])):
            text = "\n\n".join("x" * draw.choice([1, 3, 9, 40]) + " y" * draw.choice([0, 2, 30]) for _ in range(draw.randrange(0, 4)))
            rows.append((doc, place, draw.choice([None, "A", "A", "B"]), draw.choice([None, 1, 2]), draw.choice([text, text, None, " "])))
    given = spark.createDataFrame(rows, "doc int, ord int, heading string, page int, text string").repartition(3)
    got = sorted((tuple(r) for r in chunk.chunk_documents(given, "doc", small).collect()), key=repr)
    want = []
    for doc in [None, *range(12)]:
        own = pd.DataFrame([r[1:] for r in rows if r[0] == doc], columns=["ord", "heading", "page", "text"])
        want += [(doc, *(None if pd.isna(x) else x for x in r)) for r in chunk.chunked(own, small).itertuples(index=False)]
    assert got == sorted(want, key=repr) and max(r[1] for r in got) > 8


def test_pointers_are_followed_to_the_end(spark):
    chain = spark.createDataFrame([("a", i, i + 2 if i < 30 else None) for i in range(33)] + [("b", 0, None)], "doc string, i long, next long")
    assert sorted((r.doc, r.i) for r in chunk.starts(chain).collect()) == [*(("a", i) for i in range(0, 31, 2)), ("b", 0)]


# Search


def test_bm25_against_sqlite(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize=\"unicode61 remove_diacritics 0\")")
    con.executemany("INSERT INTO t (rowid, text) VALUES (?, ?)", texts.items())
    for match, terms, prefix in (("idiot OR trash OR erthe", ["idiot", "trash", "erthe"], False), ('"stup"* OR "mor"*', ["stup", "mor"], True)):
        want = dict(con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
        got = {r.doc_id: r.score for r in search.bm25(docs, terms, None, key="doc_id", prefix=prefix).collect()}
        assert got.keys() == want.keys() and want
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion_and_groups(spark):
    legs = [spark.createDataFrame([(leg, i, n + 1) for n, i in enumerate(ids)], "leg string, id int, rank int") for leg, ids in (("a", [1, 2, 3]), ("b", [3, 1]))]
    assert [r.id for r in search.top(search.fuse(legs, "id"), "score", "id", 5).collect()] == [1, 3, 2]
    rows = spark.createDataFrame([(1, "g", 0.5), (2, "g", 0.5), (3, "h", 0.1)], "id int, g string, s double")
    assert sorted(r.id for r in search.best_per(rows, "g", "s", "id").collect()) == [1, 3]
    assert "TakeOrderedAndProject" in search.knn(rows.withColumn("embedding", F.array(F.lit(1.0))), [1.0], 2)._jdf.queryExecution().executedPlan().toString()


def test_two_stages(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id int, summary_embedding array<double>")
    chunks = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id int, document_id int")
    assert sorted(r.id for r in search.two_stage(docs, chunks, [1.0, 0.1], 1).collect()) == [10, 12]


def test_scores_of_no_questions(spark):
    none = spark.createDataFrame([], "question int, file string")
    got = profile.retrieval_scores(spark.createDataFrame([], "question int, position int, file string"), none).head()
    assert tuple(got) == (0, 0.0, 0.0)
    assert profile.numeric_accuracy(spark.createDataFrame([], "question int, value double"), spark.createDataFrame([], "question int, value double")).head()[0] is None
    cites = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "x")], "question int, position int, file string")
    got = profile.retrieval_scores(cites, spark.createDataFrame([(1, "b"), (2, "y")], "question int, file string")).head()
    assert tuple(got) == (2, 0.5, 0.25)


# State


DOCS = "source_id string, item_id string, status string, content_hash string, attempts int, indexed_at string"


def test_upsert_states(spark):
    old = spark.createDataFrame([("s", "a", "indexed", "h1", 0, "t0"), ("s", "b", "error", "h2", 2, None)], DOCS)
    new = spark.createDataFrame([("s", "a", "error", None), ("s", "b", "indexed", "h3"), ("s", "c", "error", None)], "source_id string, item_id string, status string, content_hash string")
    got = {r.item_id: (r.status, r.content_hash, r.attempts, r.indexed_at) for r in state.upsert_documents(old, new, F.lit("t1")).collect()}
    assert got == {"a": ("error", "h1", 1, "t0"), "b": ("indexed", "h3", 0, "t1"), "c": ("error", None, 1, None)}
    items = spark.createDataFrame([("s", "a", "h1", None, False), ("s", "b", "h2", None, False), ("s", "z", None, None, True), ("s", "y", None, "boom", False)], "source_id string, item_id string, content_hash string, error string, unsupported boolean")
    assert {r.item_id: r.outcome for r in state.split_by_hash(items, old).collect()} == {"a": "unchanged", "b": "indexed", "z": "skipped", "y": "error"}


def test_delete_and_rename(spark):
    docs = spark.createDataFrame([(1, "i1", "A/x.pdf"), (2, "i2", "A_b/y.pdf"), (3, "i3", "A"), (4, "i4", "B/z.pdf")], "id int, item_id string, path string")
    items = spark.createDataFrame([("i4", "B/z.pdf", False), ("f", "A", True)], "item_id string, path string, is_folder boolean")
    left = state.delete_items(docs, items)
    assert sorted(r.id for r in left.collect()) == [2, 3]
    children = spark.createDataFrame([(10, 1), (11, 2)], "id int, document_id int")
    assert [r.id for r in state.cascade(children, left).collect()] == [11]
    assert {r.id: (r.path, r.retagged) for r in state.rename_folder(docs, "A", "New").collect()} == {1: ("New/x.pdf", True), 2: ("A_b/y.pdf", False), 3: ("A", False), 4: ("B/z.pdf", False)}
    tagged = spark.createDataFrame([(10, 1, "old", [0.5])], "id int, document_id int, hotel string, embedding array<double>")
    got = state.retag(tagged, spark.createDataFrame([(1, "new")], "id int, hotel string"), ["hotel"]).head()
    assert (got.hotel, got.embedding) == ("new", [0.5])


def test_supersession_and_contradiction(spark):
    schema = "id int, status string, hotel string, dataset string, entities array<string>, period_start date, period_end date, superseded_by_item string"
    d = dt.date(2026, 8, 1)
    rows = spark.createDataFrame([(1, "approved", None, "Ledger", None, d, None, None), (2, "approved", "East", "Ledger", None, d, None, None), (3, "approved", None, None, ["Pool"], None, None, None), (4, "pending", None, "Ledger", None, None, None, None), (5, "approved", None, None, None, None, None, None)], schema)
    changed = spark.createDataFrame([("i9", "ledger", "West", ["Pool", None], dt.date(2026, 7, 1), dt.date(2026, 9, 1))], "item_id string, dataset string, hotel string, entities array<string>, period_start date, period_end date")
    got = {r.id: (r.status, r.superseded_by_item) for r in state.supersede(rows, changed).collect()}
    assert got == {1: ("needs_review", "i9"), 2: ("approved", None), 3: ("needs_review", "i9"), 4: ("pending", None), 5: ("approved", None)}
    cited = spark.createDataFrame([(1, "other.pdf", None), (2, "My Ledger 2026.xlsx", None)], "position int, file string, dataset string")
    got = {r.id: r.contradicts for r in state.contradicted(rows.select("id", "dataset"), cited).collect()}
    assert got[1] == "My Ledger 2026.xlsx" and got[3] is None


def test_decisions(spark):
    rows = spark.createDataFrame([("a", "pending"), ("b", "rejected")], "id string, status string")
    assert [r.status for r in state.decide(rows, "a", True).orderBy("id").collect()] == ["approved", "rejected"]
    assert [r.status for r in state.decide(rows, "b", True).orderBy("id").collect()] == ["pending", "rejected"]


def test_memory(spark):
    t = dt.datetime(2026, 1, 1)
    facts = spark.createDataFrame([(i, 1 if i < 6 else 2, "procedural" if i == 7 else "semantic", f"Fact {i}.", t + dt.timedelta(days=i)) for i in range(8)], "id int, node_id int, kind string, text string, created timestamp")
    nodes = spark.createDataFrame([(1, "Pool"), (2, "Bar")], "id int, label string")
    hits = spark.createDataFrame([("fact", 7, 2.0), ("node", 1, 2.0), ("fact", 5, 1.0)], "kind string, ref int, score double")
    got = state.recall(hits, facts, nodes, F.lit("2026-01-08").cast("timestamp")).collect()
    assert [r.id for r in got] == [7, 2, 3, 4, 5] and abs(got[0].score - 2.2) < 1e-9 and abs(got[1].score - 1.6) < 1e-9
    new = spark.createDataFrame([(20, 1, "semantic", " fact  3 !", t + dt.timedelta(days=30)), (21, 1, "semantic", "Something new", t)], facts.schema)
    after = {r.id: r.created for r in state.add_facts(facts, new).collect()}
    assert len(after) == 9 and after[3] == t + dt.timedelta(days=30) and 20 not in after
    rules = spark.createDataFrame([(1, "Always answer in metric units"), (2, "Never mail on Sunday")], "id int, text string")
    assert sorted(r.id for r in state.save_rules(rules, spark.createDataFrame([(3, "Always answer in imperial metric units please")], rules.schema)).collect()) == [2, 3]
    edges = state.add_edges(spark.createDataFrame([(2, 1)], "a int, b int"), spark.createDataFrame([(1, "bar"), (1, "pool"), (2, "Nowhere")], "a int, label string"), nodes)
    assert [tuple(r) for r in edges.collect()] == [(1, 2)]


def test_generations(spark, tmp_path):
    registry = generations.Registry(spark, f"file://{tmp_path}/w")
    now = dt.datetime(2026, 1, 10)
    first = registry.create("m", 384)
    with pytest.raises(ValueError, match="already"):
        registry.create("m", 384)
    registry.flip(first.id, now)
    second = registry.create("m2", 384)
    spark.range(3).write.parquet(registry.directory(second.id, "documents"))
    registry.flip(second.id, now)
    assert registry.active().id == 2 and registry.writable(now) == [2, 1] and registry.writable(now + dt.timedelta(days=8)) == [2]
    with pytest.raises(ValueError, match="active"):
        registry.discard(2)
    assert registry.rollback(now + dt.timedelta(days=1)).id == 1 and registry.active().id == 1
    with pytest.raises(ValueError, match="no generation"):
        registry.rollback(now + dt.timedelta(days=30))
    assert registry.drop_expired(now + dt.timedelta(days=30)) == [2] and not (tmp_path / "w/g2").exists()
    with pytest.raises(ValueError, match="no candidate"):
        registry.flip(9, now)


def test_gate():
    g = generations.Generation
    assert generations.gate_reasons(g(2, build_total=5, build_done=5, eval_hit5=0.9), g(1, eval_hit5=0.85), 0, 1, 6) == []
    assert generations.gate_reasons(g(2, build_total=5, build_done=4, eval_hit5=0.5), g(1, eval_hit5=0.9), 3, 1, 6) == [
        "Build is not finished (4 of 5 files).",
        "More files failed than in the live generation (3 vs 1).",
        "Eval hit@5 0.50 is below 0.85.",
        "Eval hit@5 0.50 is below the live generation (0.90).",
    ]
    assert generations.gate_reasons(g(2, build_total=1, build_done=1), g(1), 0, 0, 0) == ["No eval questions configured (eval/questions.jsonl)."]


def test_memory_search(spark):
    from tessera.operators import memory

    nodes = spark.createDataFrame([(1, "Alice Varian", "Person"), (2, "Ledger", "System")], "id int, label string, type string")
    facts = spark.createDataFrame([(10, 1, "semantic", "Signs off invoices over 500", dt.datetime(2026, 1, 1)), (11, 1, "semantic", "Works on Tuesdays", dt.datetime(2026, 1, 2)), (12, 2, "procedural", "Close the month on day three", dt.datetime(2026, 1, 3))], "id int, node_id int, kind string, text string, created timestamp")
    now = F.lit("2026-01-05").cast("timestamp")
    find = lambda q: [r.id for r in memory.search(nodes, facts, q, now).collect()]
    assert find("what do you know about it") == [] and find("invoice")[0] == 10 and set(find("Varian")) == {10, 11} and find("month")[0] == 12
    assert memory.as_text(memory.search(nodes, facts, "month", now)).head().line == "- [procedural] Ledger: Close the month on day three"


def test_as_of_ties_and_gaps(spark):
    from tessera.operators import joins

    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 2, "y"), ("c", 1, "z")], "k string, t int, v string")
    assert {r.id: r.v for r in joins.as_of(left, right, ["k"], "t", ["v"]).collect()} == {1: "x", 2: None, 3: None}


def test_planned_operators(spark):
    from tessera.operators import planned

    report = [["Rooms"], ["Room", "Cost"], [101, 5], ["Bar"], ["Item", "Price"], ["Tea", 2], ["Ale", 3]]
    assert "Join" not in planned.sections(grid(spark, report))._jdf.queryExecution().optimizedPlan().toString()
    parts = planned.section_sheets(grid(spark, report))
    assert {r.sheet for r in parts.collect()} == {"s / Rooms / 1", "s / Bar / 2"}
    assert [tuple(r) for r in sheets.tidy_table(parts, "d", "s / Bar / 2").collect()] == [("Tea", 2.0), ("Ale", 3.0)]
    docs = spark.createDataFrame([(1, "Overall score: 87.5%\nﬁtness  4\nnot a line here\nClean-\nliness: 90"), (2, "Overall score: 92.5%")], "document_id int, text string")
    rows = planned.metrics(docs, "document_id", "text")
    assert {(r.document_id, r.metric, r.value) for r in rows.collect()} == {(1, "Overall score", 87.5), (1, "fitness", 4.0), (1, "Cleanliness", 90.0), (2, "Overall score", 92.5)}
    assert tuple(planned.metric_measure(rows, "overall score", "sum").head()) == (90.0, 2)
    named = spark.createDataFrame([(["a", "b", "a"],), (["b"],), (None,)], "entities array<string>")
    assert [tuple(r) for r in planned.frequent_entities(named).collect()] == [("b", 2), ("a", 1)]
    assert planned.metric_names(rows, spark.createDataFrame([(1, "Scores")], "document_id int, dataset string")).count() == 3


# Text index


LINES = ["pool heater", '"pool heater" or boiler', "heater -broken", "the", '"heater pool" -boiler', "café"]


def test_text_index_against_a_plain_search(spark):
    import random

    from tessera.functions.fulltext import cover_density, words_of
    from tessera.operators.textindex import TextIndex

    rng = random.Random(3)
    texts = [None, "", "Café POOL heater", *[" ".join(rng.choice(["pool", "heater", "boiler", "broken", "the", "x", "Heater's"]) for _ in range(rng.randint(1, 25))) for _ in range(120)]]
    index = TextIndex.of(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    words = [words_of(t or "") for t in texts]

    def has(own, phrase):
        return any(own[i : i + len(phrase)] == phrase for i in range(len(own)))

    asked = {
        LINES[0]: ([[["pool"], ["heater"]]], []), LINES[1]: ([[["pool", "heater"]], [["boiler"]]], []), LINES[2]: ([[["heater"]]], [["broken"]]),
        LINES[3]: ([[["the"]]], []), LINES[4]: ([[["heater", "pool"]]], [["boiler"]]), LINES[5]: ([[["cafe"]]], []),
    }
    for line, (alternatives, exclude) in asked.items():
        want = {}
        for i, own in enumerate(words):
            held = [all(has(own, p) for p in phrases) for phrases in alternatives]
            if any(held) and not any(has(own, p) for p in exclude):
                at = lambda terms, own=own: {t: [k for k, w in enumerate(own) if w == t] for t in terms}
                needed = [sorted({t for p in phrases for t in p}) for phrases in alternatives]
                want[i] = sum(cover_density(at(n), n) for n, h in zip(needed, held, strict=True) if h)
        got = {r.id: r.score for r in index.search(line, None).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want), line
    assert index.search("", None).count() == 0 and index.rank([], k=None).count() == 0


def test_stored_index_is_built_once_for_a_table(spark, tmp_path):
    from tessera.operators.textindex import TextIndex

    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "Invoices were paid"), (2, "one invoice"), (3, "nothing")], "id int, text string").write.parquet(path)
    index = TextIndex.stored(spark.read.parquet(path), stem=True)
    assert sorted(r.id for r in index.holding(["invoicing"]).collect()) == [1, 2] and index.totals.head() == (3, 6)
    assert TextIndex.stored(spark.read.parquet(path), stem=True).postings.inputFiles() == index.postings.inputFiles()
    spark.createDataFrame([(4, "invoice")], "id int, text string").write.mode("append").parquet(path)
    assert TextIndex.stored(spark.read.parquet(path), stem=True).holding(["invoice"]).count() == 3
    plan = index.bm25(["invoic"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,invoic)]" in plan


def test_hybrid_fuses_vectors_and_cover_density(spark):
    from tessera.operators.textindex import TextIndex
    from tessera.plans.plan import Keywords

    rows = [(1, 1, "the invoices of May", [1.0, 0.0]), (2, 1, "an invoice", [0.9, 0.1]), (3, 2, "pool heater broken", [0.0, 1.0]), (4, 3, "heater of the pool", [0.1, 0.9])]
    chunks = spark.createDataFrame(rows, "id int, section_id int, text string, embedding array<float>")
    index = TextIndex.of(chunks, stem=True)
    for given in (index, None):
        found = search.hybrid(chunks, [1.0, 0.0], Keywords(should=("invoice",)), "what", index=given).collect()
        assert [r.section_id for r in found][0] == 1 and {r.section_id for r in found} == {1, 2, 3}
        only = search.hybrid(chunks, [1.0, 0.0], Keywords(must=("pool",), exclude=("broken",)), "what", index=given).collect()
        assert [r.section_id for r in only] == [3]
        line = search.hybrid(chunks, [0.0, 1.0], Keywords(), '"pool heater"', index=given).collect()
        assert line[0].section_id == 2 and line[0].score > 1 / 61


def test_bm25_of_copies_is_equal_whatever_the_order_of_rows(spark):
    from tessera.operators.textindex import TextIndex

    terms = ["a", "b", "c", "d"]
    tf = dict(zip(terms, (1, 3, 2, 5), strict=True))
    orders = [terms, terms[::-1], ["b", "d", "a", "c"], ["c", "a", "d", "b"]]
    rows = [(t, i, tf[t], 37, [0]) for i in range(40) for t in orders[i % 4]] + [(t, 100 + i, 1, 9, [0]) for j, t in enumerate(terms) for i in range(j * 3 + 1)]
    postings = spark.createDataFrame(rows, "term string, id long, tf int, length int, positions array<int>").coalesce(1)
    index = TextIndex(postings, spark.createDataFrame([(200, 5003)], "docs long, words long"), False)
    asked = spark.createDataFrame([(1000, terms)], "question long, terms array<string>")
    for found in (index.bm25(terms, None).collect(), index.bm25_many(asked, 60).collect()):
        assert len({r.score for r in found if r.id < 100}) == 1
    best = [r.id for r in index.bm25(terms, 40).collect() if r.id < 100]
    assert best == list(range(len(best))) and len(best) > 30


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bm25_of_many_questions_makes_no_row_for_each_text(spark, monkeypatch, kind):
    """The k best of each question as one question alone has them, whatever the groups and shares; what leaves a task is k rows for a question."""
    from tessera.operators import textindex

    draw = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(draw.choices(words, range(12, 0, -1), k=draw.randrange(1, 30)))) for i in range(600)]
    docs = spark.createDataFrame(rows + [(600 + i, t) for i, t in rows[:50]], "id long, text string").withColumn("id", F.col("id").cast(kind))
    index = textindex.TextIndex.of(docs)
    lines = {q: draw.sample(words, 1 + q % 3) for q in range(7)}
    asked = spark.createDataFrame([*lines.items(), (7, ["nowhere"]), (8, []), (9, None), (10, ["w3", "w3", "w5"])], "question int, terms array<string>")
    want = {q: [(r.id, round(r.score, 12)) for r in index.bm25(t, 8).collect()] for q, t in {**lines, 10: ["w3", "w5"]}.items()}
    for postings, shares, packed in ((1 << 21, 1 << 16, 1 << 17), (40, 3, 30)):
        monkeypatch.setattr(textindex, "POSTINGS", postings)
        monkeypatch.setattr(textindex, "QUESTIONS", shares)
        monkeypatch.setattr(textindex, "AT_ONCE", packed)
        found = index.bm25_many(asked, 8)
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.question, r["rank"])):
            got.setdefault(r.question, []).append((r.id, round(r.score, 12)))
        assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert shuffles and not any("question#" in s and "id#" in s for s in shuffles)


def test_words_shuffle_as_counts(spark):
    from tessera.functions.fulltext import term_counts

    docs = spark.createDataFrame([(1, "The cat, the Cat"), (1, "cat dog"), (2, "dog"), (None, "dog dog eel"), (3, None), (4, "")], "id long, text string")
    rows = term_counts(docs, "id", "text")
    assert sorted(map(tuple, rows.collect())) == [("cat", 1, 3), ("dog", 2, 4), ("eel", 0, 1), ("the", 1, 2)]
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", rows._jdf.queryExecution().executedPlan().toString())
    assert shuffles and not any("term#" in s and "id#" in s for s in shuffles)


def test_an_index_shuffles_a_row_for_each_text_and_term(spark, tmp_path):
    from tessera.operators.textindex import TextIndex

    docs = spark.createDataFrame([(1, "the cat the the"), (2, "Étage the"), (3, None), (4, "")], "id long, text string")
    index = TextIndex.of(docs, once=True)
    want = [("cat", 1, 1, 4, [1]), ("etage", 2, 1, 2, [0]), ("the", 1, 3, 4, [0, 2, 3]), ("the", 2, 1, 2, [1])]
    assert sorted(map(tuple, index.postings.collect())) == want
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    index.write(str(tmp_path / "i"))
    again = TextIndex.read(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.postings.collect())) == want and again.totals.head() == (4, 6)
    # Texts of one id are one.
    twice = TextIndex.of(docs.unionByName(spark.createDataFrame([(1, "cat cat")], docs.schema)))
    assert sorted(map(tuple, twice.postings.filter("id = 1").collect())) == [("cat", 1, 3, 4, [0, 1, 1]), ("the", 1, 3, 4, [0, 2, 3])]


def test_a_segment_is_dealt_once(spark, tmp_path, monkeypatch):
    from tessera.operators.segments import SegmentedIndex

    dealt = []
    monkeypatch.setattr(SegmentedIndex, "_store_postings", lambda self, rows, name: dealt.append(rows._jdf.queryExecution().executedPlan().toString()))
    SegmentedIndex(spark, f"file://{tmp_path}/index").add(spark.createDataFrame([(i, "a b a") for i in range(300)], "id long, text string"))
    assert dealt[0].count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in dealt[0]


def test_long_sheets_move_as_sums(spark, monkeypatch):
    """The window that looks for a header sees the top of a sheet only; cells below are added up before they meet it, and columns meet theirs by blocks."""
    monkeypatch.setattr(sheets, "BLOCK", 16)
    rows = [["Title"], [], ["Key", "Key", None, "Since"]] + [[i, f"n{i}", None if i < 40 else "$1.50", "8/1/2026"] for i in range(60)] + [[60, "n60", "x"]]
    cells = grid(spark, rows)
    got = {(r.name, r.type): (r.n, r.last) for r in sheets.tidy_values(cells).groupBy("name", "type").agg(F.count("*").alias("n"), F.max("row").alias("last")).collect()}
    assert got == {("key", "number"): (61, 63), ("key_2", "text"): (61, 63), ("col_3", "text"): (21, 63), ("since", "date"): (60, 62)}
    plan = sheets.header_rows(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert f"< {sheets.HEADER_WITHIN + sheets.AHEAD})" in plan
    assert f"< {sheets.HEADER_WITHIN})" in sheets.sheet_columns(cells)._jdf.queryExecution().optimizedPlan().toString()
