"""Readers by extension, and parsers of office files as table functions.

Spark reads Parquet, JSON and CSV itself.  Workbooks, documents and slides are
archives of XML: they come in through binaryFile and leave as cells and
sections.  PDF text and scans need a library; parsers for them are plugged in.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 100 * 1024 * 1024
CELLS = "sheet string, row int, col int, s string"
SECTIONS = "path string, kind string, ord int, heading string, page int, text string, sheet string, row int, col int, reason string"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension; what is not known otherwise is CSV."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("xlsx", "xlsm"):
        return read_workbook(spark, path)
    if end in ("json", "jsonl"):
        return spark.read.option("multiLine", end == "json").json(path)
    if end == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_csv_grid(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180 rows as strings: blank fields are null, rows of nulls go, nothing is trimmed or typed."""
    rows = spark.read.options(multiLine=True, quote='"', escape='"', header=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = rows.select(*[F.when(F.trim(c) != "", F.col(c)).alias(c) for c in rows.columns])
    return rows.filter(F.coalesce(*[F.col(c) for c in rows.columns]).isNotNull())


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# Workbooks

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATES = {14, 15, 16, 17, 22}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _dated(styles: ET.Element | None) -> list[bool]:
    """Which cell formats show a date."""
    if styles is None:
        return []
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
    xfs = styles.find(f"{_MAIN}cellXfs")
    is_date = lambda i: i in _DATES or bool(re.search(r"[dyDY]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, ""))))
    return [is_date(int(x.get("numFmtId", 0))) for x in (xfs if xfs is not None else ())]


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, text) of filled cells: dates as ISO days, formulas by their value, errors left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        read = lambda n: ET.fromstring(z.read(n)) if n in names else None
        shared = [t for t in ("".join(x.text or "" for x in si.iter(f"{_MAIN}t")) for si in (read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else ()))]
        dated = _dated(read("xl/styles.xml"))
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        book = read("xl/workbook.xml")
        base = dt.date(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_MAIN}workbookPr")) else dt.date(1899, 12, 30)
        for sheet in book.iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")]
            root = read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            for i, row in enumerate(root.iter(f"{_MAIN}row")):
                at = int(row.get("r", i + 1)) - 1
                for j, c in enumerate(row.iter(f"{_MAIN}c")):
                    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
                    text = v.text if v is not None else None
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind == "inlineStr":
                        text = "".join(x.text or "" for x in c.iter(f"{_MAIN}t"))
                    elif kind == "e":
                        text = None
                    elif kind == "b" and text is not None:
                        text = "true" if text == "1" else "false"
                    elif kind == "n" and text is not None:
                        style = int(c.get("s", 0))
                        number = float(text)
                        text = (base + dt.timedelta(days=int(number))).isoformat() if style < len(dated) and dated[style] else str(int(number)) if number.is_integer() else repr(number)
                    if text is not None and text.strip():
                        yield sheet.get("name"), at, _column(c.get("r")) if c.get("r") else j, text.strip()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """CELLS of the workbooks at a path, in any store that Spark reads."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = list(workbook_cells(content.as_py()))
                columns = list(zip(*found, strict=True)) if found else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["sheet", "row", "col", "s"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(cells, CELLS)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as a table, by the generic normalizer."""
    from tessera.operators.sheets import tidy_table

    cells = read_cells(spark, path).withColumn("doc_id", F.lit(path))
    first = cells.select("sheet").first()
    return tidy_table(cells, path, first["sheet"]) if first else spark.createDataFrame([], "empty string")


# Documents and slides

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def markdown(rows: list[list[str]]) -> str:
    """A markdown table: bars escaped, ragged rows padded."""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def document_sections(data: bytes) -> list[tuple[str | None, str]]:
    """(heading, text): paragraphs and tables under each heading; list items begin with a dash."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for element in body:
        if element.tag == f"{_W}p" and text_of(element):
            style = element.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and re.match(r"(?i)heading|title", style.get(f"{_W}val", "")):
                out.append((text_of(element), []))
            else:
                item = element.find(f"{_W}pPr/{_W}numPr") is not None
                out[-1][1].append(("- " if item else "") + text_of(element))
        elif element.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(text_of, cell.iter(f"{_W}p")))) for cell in row.findall(f"{_W}tc")] for row in element.findall(f"{_W}tr")]
            if any(rows):
                out[-1][1].append(markdown(rows))
    return [(h, "\n\n".join(parts)) for h, parts in out if parts]


def slide_sections(data: bytes) -> list[tuple[int, str]]:
    """(number, text) of each slide, in the order of their numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        texts = [(i, " ".join(t.text for t in ET.fromstring(z.read(n)).iter(f"{_A}t") if t.text and t.text.strip())) for i, n in slides]
    return [(i, t) for i, t in texts if t]


Parser = Callable[[bytes], Iterable[dict]]


def _grid(cells: Iterable[tuple[str, int, int, str]]) -> Iterator[dict]:
    for sheet, row, col, s in cells:
        yield {"kind": "cell", "sheet": sheet, "row": row, "col": col, "text": s}


def _csv(data: bytes) -> Iterator[dict]:
    import csv

    rows = (r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline="")) if any(x.strip() for x in r))
    return _grid(("csv", i, j, x) for i, r in enumerate(rows) for j, x in enumerate(r) if x.strip())


def _text(data: bytes) -> Iterator[dict]:
    yield {"kind": "section", "ord": 0, "text": data.decode("utf-8-sig", "replace")}


def _unavailable(reason: str) -> Parser:
    return lambda data: iter([{"kind": "unsupported", "reason": reason}])


def pages(texts: Iterable[str]) -> Iterator[dict]:
    """What a PDF parser gives: sections by page, blanks at line ends removed; pages without text are named."""
    empty = []
    for n, text in enumerate(texts, 1):
        text = "\n".join(line.rstrip() for line in text.split("\n")).strip("\n")
        if text.strip():
            yield {"kind": "section", "ord": n - 1, "page": n, "text": text}
        else:
            empty.append(n)
    if empty:
        yield {"kind": "empty_pages", "text": ",".join(map(str, empty))}


#: Parsers by extension; callers add or replace them.
PARSERS: dict[str, Parser] = {
    "xlsx": lambda data: _grid(workbook_cells(data)),
    "xlsm": lambda data: _grid(workbook_cells(data)),
    "csv": _csv,
    "txt": _text,
    "md": _text,
    "docx": lambda data: ({"kind": "section", "ord": i, "heading": h, "text": t} for i, (h, t) in enumerate(document_sections(data))),
    "pptx": lambda data: ({"kind": "section", "ord": i, "page": n, "heading": f"Slide {n}", "text": t} for i, (n, t) in enumerate(slide_sections(data))),
    "pdf": _unavailable("No PDF reader is installed"),
    "xls": _unavailable("Old .xls workbooks are not supported; save as .xlsx"),
}


def _tried(parser: Parser, data: bytes, tries: int) -> list[dict]:
    """What a parser gives, at one of some tries; the error of the last."""
    for left in reversed(range(tries)):
        try:
            return list(parser(data))
        except Exception:
            if not left:
                raise
    return []


def parse_files(files: DataFrame, parsers: dict[str, Parser] | None = None, tries: int = 3) -> DataFrame:
    """SECTIONS of binaryFile rows: sections and cells, or why a file gave none; a broken file is its own error after so many tries."""
    known, names = PARSERS | (parsers or {}), [c.split()[0] for c in SECTIONS.split(", ")]
    kinds = {c.split()[0]: pa.int32() if c.endswith(" int") else pa.string() for c in SECTIONS.split(", ")}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, content in zip(*(batch.column(c) for c in ("path", "length", "content")), strict=True):
                name = path.as_py().rsplit("/", 1)[-1]
                end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                try:
                    if length.as_py() > MOST_BYTES:
                        rows = [{"kind": "skipped", "reason": "The file is larger than 100 MB"}]
                    else:
                        rows = _tried(known.get(end, _unavailable(f"Files of type .{end} are not supported")), content.as_py(), tries)
                except Exception as error:  # whatever a broken file raises belongs to that file
                    rows = [{"kind": "error", "reason": f"{type(error).__name__}: {error}"[:500]}]
                columns = {c: [r.get(c) for r in rows] for c in names} | {"path": [path.as_py()] * len(rows)}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in columns.items()})

    return files.select("path", "length", "content").mapInArrow(parse, SECTIONS)


def read_files(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), parsers)


def cells_of(sections: DataFrame) -> DataFrame:
    """The sheet cells among parsed files, as the sheet operators take them."""
    return sections.filter("kind = 'cell'").select(F.col("path").alias("doc_id"), "sheet", "row", "col", F.col("text").alias("s"))


# Configuration and questions

LEVELS = ("department", "dataset", "skip")


def load_sources(spark: SparkSession, text: str) -> DataFrame:
    """Sources of a YAML (or JSON) configuration, checked: known levels, slashes trimmed."""
    try:
        import yaml

        parsed = yaml.safe_load(text)
    except ImportError:
        import json

        parsed = json.loads(text)
    rows = []
    for s in parsed["sources"]:
        levels = s.get("levels", [])
        if unknown := [x for x in levels if x not in LEVELS]:
            raise ValueError(f"unknown folder levels {unknown} in source {s.get('id')}")
        rows.append((s["id"], s.get("business"), s.get("hotel"), s.get("root", "").strip("/"), levels))
    return spark.createDataFrame(rows, "id string, business string, hotel string, root string, levels array<string>")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with expected files and values, a JSON object a line."""
    return spark.read.schema("question string, expected_files array<string>, expected_value double").json(path).filter("question is not null")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
