from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.sheets import tidy_table
from tessera.sources import blobs, changefeed, readers
from tessera.sources.console import Console, dataset_path, translated, write_reason
from tessera.streaming import cdc

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def archive(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook() -> bytes:
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Cost</t></is></c><c r="D1" t="str"><f>1</f><v>Day</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3"><v>12.5</v></c><c r="C3" t="e"><v>#N/A</v></c><c r="D3" s="1"><v>46235</v></c></row>'
    return archive({
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><r><t>Ro</t></r><r><t>om</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>',
    })


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def document() -> bytes:
    p = lambda t, props="": f"<w:p>{props}<w:r><w:t>{t}</w:t></w:r></w:p>"
    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    table = f"<w:tbl><w:tr><w:tc>{p('a|b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl>"
    return archive({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{p("Intro")}{p("Title", style)}{p("item", "<w:pPr><w:numPr/></w:pPr>")}{table}</w:body></w:document>'})


def slides() -> bytes:
    return archive({f"ppt/slides/slide{i}.xml": f'<x xmlns:a="{A}"><a:t>slide {i}</a:t><a:t>&amp; more</a:t></x>' for i in (10, 2, 1)})


@pytest.fixture
def folder(tmp_path):
    for name, data in {"w.xlsx": workbook(), "d.docx": document(), "s.pptx": slides(), "n.md": b"\xef\xbb\xbfhello", "c.csv": b'a,b\r\n"1,5","say ""hi"""\r\n"x\ny",2\r\n,\r\n', "p.pdf": b"%PDF", "o.xls": b"x", "broken.docx": b"no zip", "u.bin": b"?"}.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_files_by_type(spark, folder):
    rows = readers.read_files(spark, f"file://{folder}").collect()
    of = lambda name: [r for r in rows if r.path.endswith(name)]
    assert [(r.sheet, r.row, r.col, r.text) for r in of("w.xlsx")] == [("S1", 0, 0, "Room"), ("S1", 0, 1, "Cost"), ("S1", 0, 3, "Day"), ("S1", 2, 0, "true"), ("S1", 2, 1, "12.5"), ("S1", 2, 3, "2026-08-01")]
    assert [(r.heading, r.text) for r in of("d.docx")[:2]] == [(None, "Intro"), ("Title", "- item\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |")]
    assert [(r.page, r.text) for r in sorted(of("s.pptx"), key=lambda r: r.ord)] == [(1, "slide 1 & more"), (2, "slide 2 & more"), (10, "slide 10 & more")]
    assert of("n.md")[0].text == "hello" and [r.text for r in of("c.csv")] == ["a", "b", "1,5", 'say "hi"', "x\ny", "2"]
    assert {r.kind for name in ("p.pdf", "o.xls", "u.bin") for r in of(name)} == {"unsupported"} and of("broken.docx")[0].kind == "error"


def test_plugged_parser(spark, folder):
    rows = readers.read_files(spark, f"file://{folder}/p.pdf", {"pdf": lambda data: readers.pages(["one  \n", " ", "three"])}).collect()
    assert [(r.kind, r.page, r.text) for r in rows] == [("section", 1, "one"), ("section", 3, "three"), ("empty_pages", None, "2")]


def test_workbook_source_and_table(spark, folder):
    cells = readers.read_cells(spark, f"{folder}/w.xlsx").withColumn("doc_id", F.lit("w"))
    assert cells.count() == 6
    table = tidy_table(cells, "w", "S1")
    assert table.columns == ["room", "cost", "day"] and [(r.room, r.cost, str(r.day)) for r in table.collect()] == [("true", 12.5, "2026-08-01")]
    assert readers.read_any(spark, f"{folder}/w.xlsx").count() == 1


def test_csv_grid(spark, folder):
    rows = [tuple(r) for r in readers.read_csv_grid(spark, f"file://{folder}/c.csv").collect()]
    assert rows == [("a", "b"), ("1,5", 'say "hi"'), ("x\ny", "2")]


def test_reader_by_extension(spark, folder, tmp_path):
    spark.range(2).write.parquet(f"file://{tmp_path}/t.parquet")
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read_any(spark, f"file://{tmp_path}/t.parquet").count() == 2
    assert readers.read_any(spark, f"file://{tmp_path}/j.jsonl").count() == 2
    assert readers.read_any(spark, f"file://{folder}/n.md").columns


def test_console(spark, tmp_path):
    spark.range(300).write.parquet(f"file://{tmp_path}/d")
    datasets = spark.createDataFrame([(7, f"file://{tmp_path}/d")], "id long, path string")
    console = Console(spark)
    assert console.register_datasets(datasets, [7, 8]) == {"kb_dataset_7": [("id", "bigint")]}
    shown = console.show("SELECT id FROM kb_dataset_7 ORDER BY id")
    assert shown.split("\n")[0] == "id" and shown.endswith("300 rows (first 200 shown)") and len(shown.split("\n")) == 202
    assert console.sql("SUMMARIZE kb_dataset_7").head().approx_unique > 250
    with pytest.raises(PermissionError):
        console.sql("COPY kb_dataset_7 TO 'x.csv'")
    assert dataset_path(datasets, "7").endswith("/d")
    for bad in ("x", "9"):
        with pytest.raises(LookupError):
            dataset_path(datasets, bad)


def test_functions_in_the_console(spark):
    console = Console(spark)
    console.function("twice", lambda x: 2 * x, "long")
    assert [r.v for r in console.sql("SELECT twice(id) AS v FROM range(3)").collect()] == [0, 2, 4]


def test_a_parser_has_three_tries(spark, folder):
    from tessera.sources.readers import _tried

    calls = []

    def late(data):
        calls.append(data)
        if len(calls) < 3:
            raise OSError("not yet")
        return [{"kind": "section"}]

    assert _tried(late, b"x", 3) == [{"kind": "section"}] and len(calls) == 3
    with pytest.raises(OSError, match="not yet"):
        calls.clear()
        _tried(late, b"x", 2)


@pytest.mark.parametrize(("sql", "flagged"), [("COPY t TO 'x'", True), ("export database 'd'", True), ("ATTACH 'x.duckdb'", True), ("ATTACH ':memory:'", False), ("SELECT copy_count FROM t", False), ("SUMMARIZE t", False), ("INSERT INTO t VALUES (1)", True), ("CREATE OR REPLACE TEMP VIEW v AS SELECT 1", False), ("DROP TABLE t", True)])
def test_write_guard(sql, flagged):
    assert bool(write_reason(sql)) == flagged


def test_dialect():
    assert translated("SELECT strftime(d, '%Y-%m'), quantile_cont(x, 0.5) FROM read_csv_auto('a.csv')") == "SELECT date_format(d, 'yyyy-MM'), percentile_cont(0.5) WITHIN GROUP (ORDER BY x) FROM csv.`a.csv`"


def test_blobs(spark, tmp_path):
    store = blobs.Blobs(spark, f"file://{tmp_path}/b")
    key = blobs.safe_key("Raw Files", "Ä/..", "")
    assert key == "raw-files/../x" or key.startswith("raw-files/")
    store.put("k/one", b"\x00\xff")
    assert store.get("k/one") == b"\x00\xff"
    store.remove("k/one")
    with pytest.raises(Exception, match="FileNotFound|does not exist"):
        store.get("k/one")


def test_feed_pages():
    calls, slept = [], []
    answers = iter([(429, {"retry-after": "3"}, {}), (500, {}, {}), (200, {}, {"items": [1], "next_link": "n"}), (200, {}, {"items": [2], "delta_link": "d"})])

    def fetch(link):
        calls.append(link)
        return next(answers)

    got = list(changefeed.pages(fetch, "c", slept.append))
    assert [p["items"] for p in got] == [[1], [2]] and calls == ["c", "c", "c", "n"] and slept == [3.0, 2.0]
    with pytest.raises(changefeed.CursorExpired):
        list(changefeed.pages(lambda link: (410, {}, {}), "old"))
    with pytest.raises(OSError, match="500"):
        list(changefeed.pages(lambda link: (500, {}, {}), "c", slept.append))
    with pytest.raises(OSError, match="404"):
        list(changefeed.pages(lambda link: (404, {}, {}), "c", slept.append))


def test_feed_rows(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"items": [{"id": "a", "name": "A", "deleted": false}, {"id": "b", "deleted": true}], "delta_link": "d"}\n')
    assert [(r.id, r.deleted) for r in changefeed.read_pages(spark, f"file://{tmp_path}").collect()] == [("a", False), ("b", True)]


def test_configuration(spark):
    rows = readers.load_sources(spark, '{"sources": [{"id": "s", "root": "/A/B/", "levels": ["department", "dataset"]}]}').collect()
    assert rows[0].root == "A/B" and rows[0].levels == ["department", "dataset"]
    with pytest.raises(ValueError, match="unknown folder levels"):
        readers.load_sources(spark, '{"sources": [{"id": "s", "levels": ["floor"]}]}')


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "a?", "expected_files": ["f"], "expected_value": 1.5}\n\n{"question": "b?", "expected_files": []}\n')
    assert readers.load_questions(spark, f"file://{tmp_path}/q.jsonl").count() == 2


def test_change_stream(spark, tmp_path):
    rows = [(1, 1, "a", False), (2, 1, "b", False), (1, 2, "a2", False), (2, 3, None, True), (3, 4, "c", False)]
    changes = spark.createDataFrame(rows, "id int, at int, v string, deleted boolean")
    for i in (1, 3):
        changes.filter(f"at between {i} and {i + 1}").coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    extra = []
    run = cdc.stream_table(stream, [cdc.versioned_sink(spark, f"file://{tmp_path}/t", "id", ("at",), "deleted"), lambda b, n: extra.append((n, b.count()))], f"file://{tmp_path}/c")
    assert run.awaitTermination(120)
    last = max(n for n, _ in extra)
    assert {r.id: r.v for r in spark.read.parquet(f"file://{tmp_path}/t/v{last}").collect()} == {1: "a2", 3: "c"} and len(extra) == 2


def test_lanes_and_pacing():
    assert cdc.slow_lane(True, 0, 0) and cdc.slow_lane(False, 201, 9999) and cdc.slow_lane(False, 11, 100) and not cdc.slow_lane(False, 11, 99)
    slept, p95 = [], iter([2000.0, 1000.0, 1000.0])
    pacer = cdc.Pacer(lambda: next(p95), slept.append)
    pacer.wait()
    pacer.wait(1.0)
    assert slept == [5.0, 3.0, 2.0]


def test_rate_cap(spark):
    events = [("s", i, sig, t) for i, (sig, t) in enumerate([("a", 0.0), ("a", 100.0), ("b", 200.0), ("c", 300.0), ("d", 400.0), ("e", 500.0), ("a", 1900.0), ("a", 3700.0), ("f", 3800.0)])]
    cap = cdc.RateCap()
    memory: dict = {}

    class Map:
        def getValue(self, k):
            return memory.get(k)

        def updateValue(self, k, v):
            memory[k] = v

        def iterator(self):
            return iter(list(memory.items()))

        def removeKey(self, k):
            del memory[k]

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    cap.seen, cap.started = Map(), Value()
    import pandas as pd

    frame = pd.DataFrame([(i, sig, t) for _, i, sig, t in events], columns=["event_id", "signature", "at"])
    admitted = pd.concat(cap.handleInputRows(("s",), iter([frame]), None))["event_id"].tolist()
    # a, b, c, d; e is the fifth of the hour; a again after half an hour is over the hour's cap; later ones pass.
    assert admitted == [0, 2, 3, 4, 7, 8]
