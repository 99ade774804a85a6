from __future__ import annotations

import datetime as dt
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dates, embedders, fulltext, numbers, text, vectors
from tessera.queries import pieces


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").withColumn("x", f(F.col("v"))).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_to_number(spark):
    cases = {"1,632.98": 1632.98, "$1,200": 1200.0, "(12.50)": -12.5, "-3": -3.0, "45%": 45.0, "7": 7.0, "abc": None, "2026-08-01": None, "(5": None, "": None, None: None, ".5": 0.5, " ( 7 ) ": -7.0}
    assert each(spark, list(cases), numbers.to_number) == list(cases.values())


def test_round_half_up(spark):
    assert each(spark, [-0.125, 0.125, 2.675, None, -1.005], numbers.round_half_up, "double") == [-0.12, 0.13, 2.68, None, -1.0]


def test_to_iso_date(spark):
    d = dt.date
    cases = {"8/1/2026": d(2026, 8, 1), "2026-08-01": d(2026, 8, 1), "12/31/2025": d(2025, 12, 31), "13/40/2025": None, "hello": None, "2026-02-31": None, "2/29/2024": d(2024, 2, 29), None: None, "": None}
    assert each(spark, list(cases), dates.to_iso_date) == list(cases.values())


@settings(max_examples=200, deadline=None)
@given(st.text("0123456789-/ ", max_size=10), st.text("0123456789-/ ", max_size=10))
def test_ranges_are_in_order_or_none(a, b):
    got = dates.normalize_range(a, b)
    assert got is None or (got[0] <= got[1] and all(re.fullmatch(r"\d{4}-\d\d-\d\d", x) for x in got))


def test_normalize_range_and_months():
    n = dates.normalize_range
    assert n("2026-01", "2026-08") == ("2026-01-01", "2026-08-31")
    assert n("2025", "2025") == ("2025-01-01", "2025-12-31")
    assert n("2026-03-31", "2026-03-01") == ("2026-03-01", "2026-03-31")
    assert n("last month", "2026") is None and n("2026-13", "2026") is None and n("2026-02-31", "2026") is None
    assert dates.months_between("2025-11-01", "2026-02-28") == ["2025-11", "2025-12", "2026-01", "2026-02"]
    assert len(dates.months_between("1900-01-01", "2026-01-01")) == 60 and dates.months_between("2026-05-01", "2026-01-01") == ["2026-05"]


def test_months_of_matches_the_driver(spark):
    for a, b in (("2025-11-15", "2026-02-28"), ("1990-01-01", "2026-01-01"), ("2026-05-01", "2026-01-01")):
        assert one(spark, dates.months_of(F.lit(a).cast("date"), F.lit(b).cast("date"))) == dates.months_between(a, b)


def test_relative_ranges():
    today = dt.date(2026, 3, 15)
    assert dates.resolve_relative("last month", today) == ("2026-02-01", "2026-02-28")
    assert dates.resolve_relative("YTD", today) == ("2026-01-01", "2026-03-15")
    assert dates.resolve_relative("2024-05", today) == ("2024-05-01", "2024-05-31") and dates.resolve_relative("someday", today) is None


PERIODS = [
    (["Accounting", "Labor", "2026", "09 - September"], "2026-09-01__Labor_Summary.xlsx", "2026-09-01", "2026-09-01", "day"),
    (["Accounting", "GL's", "2026"], "01.2026 Detail.xlsx", "2026-01-01", "2026-01-31", "month"),
    (["Accounting", "Labor", "2026", "07 - July"], "summary.xlsx", "2026-07-01", "2026-07-31", "month"),
    (["F&B", "Inventories", "2026", "8 Aug"], "count.xlsx", "2026-08-01", "2026-08-31", "month"),
    (["F&B"], "Weekly Sales 9.5-9.11.xlsx", "2026-09-05", "2026-09-11", "week"),
    (["F&B"], "comparison October 2025.xlsx", "2025-10-01", "2025-10-31", "month"),
    (["Guest Scores", "Stay Experience 2024"], "Scores Feb 2024.pdf", "2024-02-01", "2024-02-29", "month"),
    (["Guest Scores", "Stay Experience 2024"], "notes.docx", "2024-01-01", "2024-12-31", "year"),
    (["m3labor", "2025", "08"], "labor.xlsx", "2025-08-01", "2025-08-31", "month"),
    ([], "Projects.xlsx", "2026-09-29", "2026-09-29", None),
    (["Marketing"], "Market Analysis.pdf", "2026-09-29", "2026-09-29", None),
    ([], "2026-02-31 odd.xlsx", "2026-01-01", "2026-12-31", "year"),
]


def test_parse_period(spark):
    rows = spark.createDataFrame([(i, f, n, "2026-09-29T13:25:41Z") for i, (f, n, *_) in enumerate(PERIODS)], "i int, folders array<string>, file string, modified string")
    rows = rows.withColumn("modified", F.to_timestamp("modified"))
    got = rows.select("i", dates.parse_period("folders", "file", "modified").alias("p")).orderBy("i").collect()
    assert [(str(r.p.start), str(r.p.end), r.p.grain) for r in got] == [tuple(p[2:]) for p in PERIODS]


def test_strip_dates(spark):
    cases = {"Stay Experience 2024": "Stay Experience", "Report October 2025": "Report", "Weekly 9.5-9.11": "Weekly", "01.2026 X": "X", "2026-09-01__X": "X", "GL's": "GL's"}
    assert each(spark, list(cases), dates.strip_dates) == list(cases.values())


def test_headers_and_labels(spark):
    label = dates.period_label(F.lit("2024-08-01").cast("date"), F.lit("2024-08-31").cast("date"), F.lit("month"))
    assert one(spark, dates.context_header(F.lit("Hotel"), F.lit(""), F.lit(None).cast("string"), label, F.lit("Head"))) == "Hotel › Aug 2024 › Head"
    assert one(spark, dates.period_display(F.lit("2024-08-01"), F.lit("2024-08-31"))) == "2024-08-01 to 2024-08-31"


def test_derive_meta(spark):
    row = spark.createDataFrame([(["Accounting", "Labor 2026", "09 - September"], "x.XLSX", "2026-01-01")], "folders array<string>, file string, modified string")
    got = row.select(*dates.derive_meta("folders", "file", "modified", ["department", "dataset"])).head()
    assert (got.department, got.dataset, str(got.period.start), got.file_type) == ("Accounting", "Labor", "2026-09-01", "xlsx")


def test_names_and_texts(spark):
    assert one(spark, text.snake(F.lit("GL's Total ($)"))) == "gls_total" and one(spark, text.slug(F.lit("///"))) == "x"
    assert one(spark, text.storage_key(F.lit("Raw Files"), F.lit("A/b"))) == "raw-files/a-b"
    assert one(spark, text.clip(F.lit("abcdef"), 4)) == "abc…" and one(spark, text.clip(F.lit("abcd"), 4)) == "abcd"
    assert one(spark, text.normal_fact(F.lit(" Likes  TEA. "))) == "likes tea"
    assert one(spark, text.keywords(F.lit("Who is my manager at Eastside?"))) == ["manager", "eastside"]
    assert one(spark, text.keywords(F.lit("Hey Bot, tell me"), ("bot",))) == [] and one(spark, text.token_estimate(F.lit("abcde"))) == 2
    assert one(spark, text.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 1.0
    assert one(spark, text.html_text(F.lit("<style>p{}</style><p>A &amp; B</p><br>C<script>x</script>"))) == "A & B\n\nCx"
    assert one(spark, text.error_signature(F.lit("task"), F.lit("req_ab1 failed 12 at deadbeef99"))) == "task: failed # at "
    for message, left in (("fail req_abc_def x", "fail _def x"), ("myreq_abc1 y", "my y"), ("x abcdef_1 ABCDEF99-2", "x abcdef_# -#")):
        assert one(spark, text.error_signature(F.lit("task"), F.lit(message))) == f"task:{left}"
    assert one(spark, text.redact(F.lit("sent Bearer abc and abc"), {"authorization": "Bearer abc"})) == "sent [redacted] and [redacted]"
    assert one(spark, text.key_rules(F.lit("alice:k1, bob:k2"))) == {"alice": "k1", "bob": "k2"}


def test_tables_of_pages(spark):
    page = "<table><tr><th>a</th><th>b|c</th></tr><tr><td>1 &amp; 2</td></tr></table>"
    rows = one(spark, text.html_tables(F.lit(page)))
    assert rows == [[["a", "b|c"], ["1 & 2"]]]
    assert one(spark, text.markdown_table(text.html_tables(F.lit(page))[0])) == "| a | b\\|c |\n| --- | --- |\n| 1 & 2 |  |"


def test_tables_are_made_once(spark):
    """A markdown table mentions its page once, so no row cuts the page again; pages of one small file go over several tasks."""
    assert str(text.markdown_table(F.get(text.html_tables("page"), 0))).count("</table>") == 1
    page = "<table><tr><td>a<br>1</td></tr><tr></tr><tr><td>2 > 1</td><td><b>|</b></td><td>c</td></tr></table>"
    assert one(spark, text.markdown_table(F.get(text.html_tables(F.lit(page)), 0))) == "| a1 |  |  |\n| --- | --- | --- |\n|  |  |  |\n| 2 > 1 | \\| | c |"
    assert one(spark, text.markdown_table(F.get(text.html_tables(F.lit("no table")), 0))) is None
    assert one(spark, text.html_text(F.lit("a<style>x</style>b<STYLE>c"))) == "abc"
    assert pieces.tables_to_markdown(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_relative_segments(spark):
    f = lambda p, root="Root": one(spark, text.relative_segments(F.lit(p), root))
    assert f("/drives/x/root:/Root/A%20b/C+d") == ["A b", "C+d"] and f("/drives/x/root:/Root") == []
    assert f("/drives/x/root:/Root Annex/A") is None and f("/drives/x/root:/Other") is None


@pytest.mark.parametrize(("command", "reason"), [("rm -rf /tmp/x", "Recursive delete"), ("ls | rm", "Delete of piped items"), ("format c:", "Disk operation"), ("reg delete HKLM\\x", "Registry delete"), ("git push origin --force", "Force push"), ("git reset --hard", "Hard reset"), ("git clean -fd", "git clean"), ("cipher /w c:", "Permanent erase"), ("git push origin main", None), ("echo hi", None)])
def test_destructive(spark, command, reason):
    assert one(spark, text.destructive_reason(F.lit(command))) == reason


def test_click_risk(spark):
    assert each(spark, ["Pay now", "Remove item", "Reply all", "Open", None], text.click_risk) == ["Pay", "Delete", "Send", None, None]


def test_vectors(spark):
    assert one(spark, vectors.fnv1a(F.lit("amazon"))) == 245108205
    v = [F.lit([1.0, 0.0]), F.lit([1.0, 1.0]), F.lit([0.0, 0.0])]
    assert math.isclose(one(spark, vectors.cosine(v[0], v[1])), math.sqrt(0.5)) and one(spark, vectors.cosine(v[0], v[2])) == 0.0
    assert 8 <= one(spark, vectors.canvas_place(F.lit("Alice"))) <= 91
    sparse = vectors.hash_embedding(spark.createDataFrame([(1, "a b a"), (2, "")], "id int, t string"), "id", "t").collect()
    dense = embedders.hashed_words("a b a")
    assert {r.bucket: round(r.weight, 9) for r in sparse} == {i: round(x, 9) for i, x in enumerate(dense) if x} and math.isclose(sum(x * x for x in dense), 1)
    assert embedders.hashed_words("") == [0.0] * 384
    with pytest.raises(LookupError):
        embedders.embedder("none such")


def test_embedding_moves_counts_only(spark, monkeypatch):
    """Words are counted where they lie: one exchange, of counts; long words, other letters, rows of one key and texts without words as by the word."""
    texts = [(1, "a b a"), (1, "A é1b2é " + "z" * 70), (2, "x" * 63 + " " + "x" * 64 + " " + "x" * 65), (3, None), (4, ""), (5, "end"), (6, "end"), (7, "İstanbul \u212a9")]
    monkeypatch.setattr(vectors, "CHUNK", 5)
    found = vectors.hash_embedding(spark.createDataFrame(texts, "id int, t string"), "id", "t")
    assert len(re.findall(r"Exchange|RepartitionByExpression", found._jdf.queryExecution().optimizedPlan().toString())) == 1 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.id, {})[r.bucket] = round(r.weight, 9)
    want = {}
    for i, t in texts:
        want[i] = want.get(i, "") + " " + (t or "")
    # Python and Spark lower these letters alike.
    assert got == {i: kept for i, t in want.items() if (kept := {b: round(x, 9) for b, x in enumerate(embedders.hashed_words(t)) if x})}


def test_embedding_refresh(spark):
    rows = spark.createDataFrame([(1, "a b", [0.0], "old"), (2, "c", [1.0], "hashed-words-384")], "id int, text string, embedding array<float>, embedding_model string")
    got = {r.id: r for r in embedders.refreshed(rows, "text", "hashed-words-384").collect()}
    assert len(got[1].embedding) == 384 and got[1].embedding_model == "hashed-words-384" and got[2].embedding == [1.0]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("invoices", "invoic"), ("invoice", "invoic"), ("running", "run"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("happy", "happi"), ("national", "nation"), ("consignment", "consign"), ("knightly", "knight"), ("sky", "sky"), ("dying", "die"), ("as", "as"), ("kindness", "kind"), ("controlling", "control"), ("adoption", "adopt"), ("bottles", "bottl")])
def test_porter2(word, stem):
    assert fulltext.porter2(word) == stem


def test_queries_of_words():
    assert fulltext.any_or_all(["the invoices", "of"], True) == [["invoic"]] and fulltext.any_or_all(["the"], False) is None
    assert fulltext.websearch('"pool heater" or boiler -broken') == ([[["pool", "heater"]], [["boiler"]]], [["broken"]])


def test_cover_density():
    near, far = {"a": [1], "b": [2]}, {"a": [1], "b": [9]}
    assert fulltext.cover_density(near, ["a", "b"]) > fulltext.cover_density(far, ["a", "b"]) > 0
    assert fulltext.cover_density({"a": [1]}, ["a", "b"]) == 0 and math.isclose(fulltext.cover_density({"a": [1, 5, 9]}, ["a"]), 0.3)


def test_expressions_stay_short(spark):
    # Planning and compiling take time by the length of an expression.
    assert len(str(numbers.to_number("s"))) <= 5_000
    assert len(str(dates.parse_period("folders", "file", "modified"))) <= 10_000
