"""Operators that are specified but not in service; callers opt in by importing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import round_half_up, to_number
from tessera.operators.sheets import SHEET, filled

ENTITIES = 300
# Ligatures that PDF text uses for pairs of letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def sections(cells: DataFrame) -> DataFrame:
    """Cells of a report of many tables with the number and title of their section.

    A row with one filled text cell opens a section and is not part of it.
    Cells are dealt and sorted once, by sheet and row; nothing is joined back.
    """
    order = Window.partitionBy(*SHEET).orderBy("row")
    same = order.rangeBetween(Window.currentRow, Window.currentRow)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = (F.count("*").over(same) == 1) & to_number("s").isNull()
    marked = filled(cells).withColumn("opens", opens)
    marked = marked.withColumn("section", F.sum(F.col("opens").cast("int")).over(so_far)).withColumn("section_title", F.last(F.when(F.col("opens"), F.col("s")), ignorenulls=True).over(so_far))
    return marked.filter(~F.col("opens")).select(*SHEET, "row", *[c for c in cells.columns if c not in (*SHEET, "row")], "section", "section_title")


def section_sheets(cells: DataFrame) -> DataFrame:
    """Each section as a sheet of its own, for the generic normalizer."""
    named = F.concat_ws(" / ", "sheet", F.coalesce("section_title", F.lit("top")), F.col("section").cast("string"))
    return sections(cells).select("doc_id", named.alias("sheet"), "row", "col", "s")


def repaired(text: str) -> F.Column:
    """PDF text with ligatures as letters and words that a line end cut joined."""
    c = F.col(text)
    for sign, letters in LIGATURES.items():
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return F.regexp_replace(c, r"(\p{L})-\n(\p{L})", "$1$2")


def metrics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, metric, value: 'Label: 12.5%' and 'Label  12.5' lines of report texts."""
    line = F.explode(F.split(repaired(text), r"\n"))
    rows = docs.select(key, line.alias("line"))
    pattern = r"^\s*([A-Za-z][A-Za-z &/'-]{1,60}?)\s*[:\s]\s*(\(?-?\$?[\d,]*\.?\d+\)?%?)\s*$"
    found = rows.select(key, F.trim(F.regexp_extract("line", pattern, 1)).alias("metric"), to_number(F.regexp_extract("line", pattern, 2)).alias("value"))
    return found.filter("metric != '' and value is not null")


def metric_measure(rows: DataFrame, metric: str, agg: str, by: str | None = None) -> DataFrame:
    """An aggregate of one metric; a sum of scores means nothing and becomes their average."""
    use = {"sum": F.avg, "avg": F.avg, "min": F.min, "max": F.max}[agg]
    keys = [by] if by else []
    return rows.filter(F.lower("metric") == metric.lower()).groupBy(*keys).agg(round_half_up(use("value")).alias("value"), F.count("*").alias("rows")).filter("rows > 0")


def metric_names(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct metrics and the datasets that have them."""
    return rows.join(documents.select("document_id", "dataset"), "document_id").select("dataset", "metric").distinct()


def frequent_entities(rows: DataFrame, column: str = "entities", most: int = ENTITIES) -> DataFrame:
    """The entities that most rows name."""
    names = rows.select(F.explode(F.array_distinct(column)).alias("name")).filter("name is not null")
    return names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(most)
