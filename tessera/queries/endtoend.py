"""From files and questions to answers: several operators in a row, as their users call them."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import search, sheets
from tessera.operators.generations import Registry
from tessera.plans.catalog import load_catalog
from tessera.plans.filters import And, Eq, Not
from tessera.plans.measure import run_measure
from tessera.plans.plan import Keywords, RawMeasure, RawPlan, validate_plan
from tessera.queries.base import query, table
from tessera.queries.retrieval import COSINE, LABELS, asked, indexed
from tessera.sources import readers
from tessera.sources.shared import shared_path

# A plan over many tidy files of two schemas


@query("""SELECT year(o_orderdate)::INT AS year, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS value, count(*) AS rows FROM orders
          WHERE (o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' OR o_orderdate BETWEEN DATE '1998-02-01' AND DATE '1998-11-30') AND o_orderpriority ILIKE '%low%' GROUP BY 1""")
def plan_measured(spark, sf):
    """A planner's measure: checked against the catalog, files pruned by the registry, footers read in tasks, added up by year."""
    root = shared_path(spark, "tidy")
    day = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select(day.alias("post_date"), F.col("o_totalprice").cast("double").alias("amount"), F.col("o_orderpriority").alias("priority"), F.date_format(day, "yyyy-MM").alias("month"))
    # Files before 1997 have a column less.
    for part, frame in (("a", rows.filter("post_date < '1997-01-01'").withColumn("extra", F.lit(1.0))), ("b", rows.filter("post_date >= '1997-01-01'"))):
        frame.repartition("month").write.partitionBy("month").parquet(f"{root}/{part}")
    first = F.trunc("post_date", "MM")
    path = F.concat(F.lit(f"{root}/"), F.when(F.col("period_start") < "1997-01-01", "a").otherwise("b"), F.lit("/month="), F.date_format("period_start", "yyyy-MM"))
    months = rows.select(first.alias("period_start")).distinct().withColumn("period_end", F.last_day("period_start")).withColumn("id", F.date_format("period_start", "yyyyMM").cast("long"))
    known = months.select("id", F.lit("Eastside").alias("hotel"), F.lit("Accounting").alias("department"), F.lit("Orders").alias("dataset"), F.lit("xlsx").alias("file_type"), "period_start", "period_end")
    columns = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in (("post_date", "date"), ("amount", "number"), ("priority", "text"))])
    datasets = known.withColumns({"document_id": F.col("id"), "path": path, "columns": columns})
    documents = known.withColumns({"name": F.concat(F.col("id").cast("string"), F.lit(".xlsx")), "web_url": F.lit(None).cast("string"), "status": F.lit("indexed")})
    raw = RawPlan("numeric", every=(("hotel", "eastside"),), any_of_periods=(("1996", "1996"), ("1998-11", "1998-02")), measure=RawMeasure("orders", "sum", "amount", (("priority", "LOW"),), ("year",)))
    plan, _ = validate_plan(raw, load_catalog(documents, datasets))
    return run_measure(spark, datasets, documents, plan)[0]


# A question by both legs under a filter


@query(rf"""WITH d AS (SELECT doc_id AS id, source, embedding, label, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS words FROM documents JOIN embeddings ON doc_id = vec_id),
                c AS (SELECT *, {COSINE.format(0)} AS near FROM d WHERE label <> 3 AND list_contains(words, 'the') AND NOT list_contains(words, 'stupid')),
                legs AS (SELECT id, row_number() OVER (ORDER BY near DESC, id) AS place FROM c QUALIFY place <= 40
                         UNION ALL SELECT id, row_number() OVER (ORDER BY len(list_filter(words, lambda w: w IN ('the', 'idiot', 'erent'))) * 0.1::DOUBLE DESC, id) AS place FROM c QUALIFY place <= 40),
                f AS (SELECT id, sum(1.0::DOUBLE / (60 + place)) AS score FROM legs GROUP BY id),
                best AS (SELECT source AS section_id, id, f.score AS s FROM f JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY f.score DESC, id) = 1)
           SELECT section_id, id, round(s, 9) AS score FROM best ORDER BY s DESC, id LIMIT 8""")
def hybrid_under_filter(spark, sf):
    """The best chunk of each section for a question with keywords, some of them excluded, under a filter."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section_id"), "text")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("label"))
    keywords = Keywords(must=("the",), should=("idiot", "erent"), exclude=("stupid",))
    out = search.hybrid(texts.join(vectors, "id"), asked(spark, sf, 0), keywords, "", where=And((Not(Eq("dataset", "3")),)), layout=LABELS, index=indexed(spark, sf))
    return out.select("section_id", "id", F.round("score", 9).alias("score"))


# Office files of every kind, written and read back

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAWN = "http://schemas.openxmlformats.org/drawingml/2006/main"
RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
LINKED = "http://schemas.openxmlformats.org/package/2006/relationships"


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _workbook(key: int, name: str) -> bytes:
    cells = f'<row r="1"><c r="A1" t="inlineStr"><is><t>{name}</t></is></c><c r="C1"><v>{key}</v></c></row><row r="3"><c r="B3" t="b"><v>1</v></c></row>'
    return _archive({
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATED}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{LINKED}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{cells}</sheetData></worksheet>',
    })


def _document(key: int, name: str) -> bytes:
    p = lambda t, props="": f"<w:p>{props}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('k|ey')}</w:tc><w:tc>{p(key)}</w:tc></w:tr><w:tr><w:tc>{p('x')}</w:tc></w:tr></w:tbl>"
    heading, item = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>', "<w:pPr><w:numPr/></w:pPr>"
    return _archive({"word/document.xml": f'<w:document xmlns:w="{WORDS}"><w:body>{p(name, heading)}{p("entry", item)}{table}</w:body></w:document>'})


def _slides(key: int, name: str) -> bytes:
    return _archive({f"ppt/slides/slide{n}.xml": f'<x xmlns:a="{DRAWN}"><a:t>{name}</a:t><a:t>&amp; {n}</a:t></x>' for n in (10, 2, 1)})


OFFICE = {"xlsx": _workbook, "docx": _document, "pptx": _slides, "csv": lambda key, name: f'﻿name,key\r\n"{name}",{key}\r\n,\r\n'.encode(), "md": lambda key, name: f"# {name}".encode(), "xls": lambda key, name: b"old"}


@query("""WITH n AS (SELECT n_nationkey AS key, n_name AS name FROM nation)
          SELECT key, 'xlsx' AS type, 'cell' AS kind, NULL AS place, 'S:0:0=' || name || ';S:0:2=' || key || ';S:2:1=true' AS content FROM n
          UNION ALL SELECT key, 'csv', 'cell', NULL, 'csv:0:0=name;csv:0:1=key;csv:1:0=' || name || ';csv:1:1=' || key FROM n
          UNION ALL SELECT key, 'docx', 'section', name, '- entry' || chr(10) || chr(10) || '| k\\|ey | ' || key || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| x |  |' FROM n
          UNION ALL SELECT key, 'pptx', 'section', 'Slide ' || s, name || ' & ' || s FROM n, (VALUES (1), (2), (10)) t(s)
          UNION ALL SELECT key, 'md', 'section', NULL, '# ' || name FROM n
          UNION ALL SELECT key, 'xls', 'unsupported', NULL, 'Old .xls workbooks are not supported; save as .xlsx' FROM n""".replace("\\\\|", "\\|"))
def office_files_read(spark, sf):
    """A file of each kind for every nation, put into a folder by tasks and parsed by tasks; cells of a sheet in one line."""
    from pyarrow.fs import FileSystem

    root = shared_path(spark, "office")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                fs.create_dir(f"{at}/{row['n_nationkey']}", recursive=True)
                for end, made in OFFICE.items():
                    with fs.open_output_stream(f"{at}/{row['n_nationkey']}/file.{end}") as out:
                        out.write(made(row["n_nationkey"], row["n_name"]))
            yield batch.select(["n_nationkey"])

    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    nations.repartition(4).mapInArrow(write, "n_nationkey long").write.format("noop").mode("overwrite").save()
    parsed = readers.read_files(spark, root).withColumns({"key": F.element_at(F.split("path", "/"), -2).cast("int"), "type": F.substring_index("path", ".", -1)})
    place = F.concat_ws(":", "sheet", "row", "col")
    cell = F.struct("sheet", "row", "col", F.concat(place, F.lit("="), F.col("text")).alias("t"))
    cells = parsed.filter("kind = 'cell'").groupBy("key", "type", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["t"]), ";").alias("content"))
    others = parsed.filter("kind != 'cell'").select("key", "type", "kind", F.col("heading").alias("place"), F.coalesce("text", "reason").alias("content"))
    return cells.select("key", "type", "kind", F.lit(None).cast("string").alias("place"), "content").unionByName(others)


# Header rows, and generations of a warehouse


@query("""WITH r AS (SELECT conv_id, turn, length(text) >= 200 AS two, max(turn) OVER (PARTITION BY conv_id) AS last_turn,
                            max((length(text) >= 200)::INT) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM conversations)
          SELECT conv_id::VARCHAR AS doc_id, min(turn)::INT AS header FROM r WHERE two AND ahead = 1 AND turn < least(last_turn, 30) GROUP BY conv_id""")
def header_rows_found(spark, sf):
    """Conversations as sheets, a turn a row, of two cells where its text is long: the first such row with another close behind."""
    c = table(spark, sf, "conversations")
    cell = lambda rows, col, s: rows.select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("s").alias("sheet"), F.col("turn").cast("int").alias("row"), F.lit(col).alias("col"), s.alias("s"))
    cells = cell(c, 0, F.concat(F.lit("by "), "role")).unionByName(cell(c.filter(F.length("text") >= 200), 1, F.concat(F.lit("says "), F.left("text", F.lit(20)))))
    return sheets.header_rows(cells).select("doc_id", "header")


@query("""SELECT 'g1' AS origin, n_name, '3:building,2:retired,1:active' AS listed FROM nation""")
def generations_rolled_back(spark, sf):
    """Two generations of a table become active one after the other, a third is being built, and the second is rolled back."""
    registry = Registry(spark, shared_path(spark, "warehouse"))
    nation, now = table(spark, sf, "nation").select("n_name"), dt.datetime(2026, 3, 15)
    for n, rows in enumerate((nation, nation.withColumn("n_name", F.lower("n_name")), nation.limit(0)), 1):
        made = registry.create("hashed", 384)
        rows.withColumn("origin", F.lit(f"g{made.id}")).write.parquet(registry.directory(made.id, "nation"))
        if n < 3:
            registry.flip(made.id, now + dt.timedelta(days=n))
    back = registry.rollback(now + dt.timedelta(days=3))
    listed = ",".join(f"{g.id}:{g.status}" for g in sorted(registry.all(), key=lambda g: -g.id))
    return spark.read.parquet(registry.directory(back.id, "nation")).select("origin", "n_name", F.lit(listed).alias("listed"))
