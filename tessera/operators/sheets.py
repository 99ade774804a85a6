"""Report-style sheets to typed tables.

A sheet is long: doc_id, sheet, row, col, s, a missing cell being an absent
row.  Header rows, types and names come from windows and aggregates over all
sheets at once; only the last step, where each sheet gets columns of its own,
knows a single sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import to_iso_date
from tessera.functions.numbers import to_number
from tessera.functions.text import row_text, snake

SHEET = ("doc_id", "sheet")
HEADER_WITHIN, AHEAD, TEXT_SHARE = 30, 3, 0.6
#: Rows of a sheet whose cells of one column a task joins at once.
BLOCK = 1 << 16
LEDGER_TITLE, LEDGER_TOP, LEDGER_HEADER = "general ledger activity detail", 12, 15

# Headings of a ledger report and the columns they fill.
LEDGER_HEADERS = {
    "post date": "post_date", "invoice": "invoice", "reference": "reference", "detail description": "detail_description",
    "debit": "debit", "credit": "credit", "jeid": "jeid", "invoice no": "invoice_no", "source": "source",
}
LEDGER_COLUMNS = (
    "account string, account_name string, post_date date, invoice string, reference string, detail_description string, debit double, credit double, jeid string, invoice_no string, source string"
)


def filled(cells: DataFrame) -> DataFrame:
    return cells.filter("s is not null and s != ''")


def header_rows(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, header: the first row with two cells or more, mostly text, and data within the next three rows."""
    # A long sheet has no more than its top looked at.
    top = filled(cells).filter(F.col("row") < HEADER_WITHIN + AHEAD)
    per = top.groupBy(*SHEET, "row").agg(F.count("*").alias("cells"), F.sum((to_number("s").isNull() & to_iso_date("s").isNull()).cast("int")).alias("text"))
    last = cells.groupBy(*SHEET).agg(F.max("row").alias("last"))
    # Rows follow each other by number, so that empty ones count.
    ahead = Window.partitionBy(*SHEET).orderBy("row").rangeBetween(1, AHEAD)
    per = per.withColumn("data", F.max((F.col("cells") >= 2).cast("int")).over(ahead)).join(last, [*SHEET])
    good = per.filter((F.col("row") < F.least(F.col("last"), F.lit(HEADER_WITHIN))) & (F.col("cells") >= 2) & (F.col("text") / F.col("cells") >= TEXT_SHARE) & (F.col("data") == 1))
    return good.groupBy(*SHEET).agg(F.min("row").alias("header"))


def kinds(values: Column) -> list[Column]:
    """number, date: whether all filled values are; null where nothing is filled."""
    all_are = lambda parsed: F.bool_and(F.when(values.isNotNull(), parsed.isNotNull()))
    return [all_are(to_number(values)).alias("number"), all_are(to_iso_date(values)).alias("date")]


def unique_names(columns: DataFrame, group: tuple[str, ...], name: str, order: str) -> DataFrame:
    """Names that occurred before in the group get _2, _3 and so on."""
    n = F.row_number().over(Window.partitionBy(*group, name).orderBy(order))
    return columns.withColumn("__n", n).withColumn(name, F.when(F.col("__n") > 1, F.concat_ws("_", name, "__n")).otherwise(F.col(name))).drop("__n")


def sheet_columns(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, header, col, name, type of each column that holds anything.

    A column is a number if all filled values are, else a date if all are, else
    text.  Only cells near the top are asked where the header is: those further
    down lie below it and are added up before they move.
    """
    body, header = filled(cells), header_rows(cells)
    top = body.filter(F.col("row") < HEADER_WITHIN).join(header, [*SHEET]).filter("row >= header")
    value = F.when(F.col("row") > F.col("header"), F.col("s"))
    top = top.groupBy(*SHEET, "header", "col").agg(F.max(F.when(F.col("row") == F.col("header"), F.col("s"))).alias("title"), *kinds(value))
    deep = body.filter(F.col("row") >= HEADER_WITHIN).groupBy(*SHEET, "col").agg(*kinds(F.col("s"))).join(header, [*SHEET])
    whole = top.unionByName(deep, allowMissingColumns=True).groupBy(*SHEET, "header", "col")
    named = whole.agg(F.max("title").alias("title"), F.when(F.bool_and("number"), "number").when(F.bool_and("date"), "date").otherwise("text").alias("type"))
    title = snake(F.coalesce("title", F.lit("")))
    named = named.withColumn("name", F.when(title != "", title).otherwise(F.concat(F.lit("col_"), (F.col("col") + 1).cast("string"))))
    return unique_names(named, SHEET, "name", "col").select(*SHEET, "header", "col", "name", "type")


def tidy_values(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, row, name, type, number, date, text: the generic table in long form, empty rows gone.

    Cells meet their column by blocks of rows, so that no task has a long column whole.
    """
    block = lambda row: F.floor(F.col(row) / BLOCK)
    last = cells.groupBy(*SHEET).agg(F.max("row").alias("last"))
    columns = sheet_columns(cells).join(last, [*SHEET]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block("last")))).drop("last")
    data = filled(cells).withColumn("block", block("row")).join(columns, [*SHEET, "col", "block"]).filter("row > header")
    as_ = lambda kind, c: F.when(F.col("type") == kind, c)
    return data.select(*SHEET, "row", "col", "name", "type", as_("number", to_number("s")).alias("number"), as_("date", to_iso_date("s")).alias("date"), as_("text", F.col("s")).alias("text"))


def tidy_table(cells: DataFrame, doc_id: str, sheet: str) -> DataFrame:
    """One sheet as a table of typed columns, in the order of its rows."""
    here = (F.col("doc_id") == doc_id) & (F.col("sheet") == sheet)
    columns = sheet_columns(cells.filter(here)).orderBy("col").collect()  # as many as the sheet has columns
    long = tidy_values(cells.filter(here))
    of = {"number": "number", "date": "date", "text": "text"}
    wide = long.groupBy("row").agg(*[F.max(F.when(F.col("name") == c["name"], F.col(of[c["type"]]))).alias(c["name"]) for c in columns])
    return wide.orderBy("row").drop("row")


def is_ledger(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, header of sheets with the ledger's title near the top and its date heading."""
    word = F.lower(F.trim("s"))
    per = cells.groupBy(*SHEET).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("row") < LEDGER_TOP, F.struct("row", "col", word.alias("w"))))), lambda x: x["w"]), " ").alias("top"),
        F.min(F.when((F.col("row") < LEDGER_HEADER) & (word == "post date"), F.col("row"))).alias("header"),
    )
    return per.filter(F.contains("top", F.lit(LEDGER_TITLE)) & F.col("header").isNotNull()).select(*SHEET, "header")


def ledger(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, row and LEDGER_COLUMNS of all ledger sheets, accounts carried down to their entries."""
    body = cells.join(is_ledger(cells), [*SHEET])
    heading = F.create_map(*[F.lit(x) for pair in LEDGER_HEADERS.items() for x in pair])
    titles = body.filter("row = header").withColumn("name", F.try_element_at(heading, F.lower(F.trim("s")))).filter("name is not null")
    titles = titles.groupBy(*SHEET, "name").agg(F.min("col").alias("col"))
    below = body.filter("row > header")
    names = [n for n in LEDGER_HEADERS.values()]
    entry = below.join(titles, [*SHEET, "col"]).groupBy(*SHEET, "row").agg(*[F.max(F.when(F.col("name") == n, F.trim("s"))).alias(n) for n in names])
    account = F.rlike(F.trim("s"), F.lit(r"^\d{4,}\.\d{3}$"))
    texts = F.sort_array(F.collect_list(F.struct("col", F.trim("s").alias("s"))))
    accounts = below.groupBy(*SHEET, "row").agg(F.min(F.when(account, F.struct("col", F.trim("s").alias("s")))).alias("account"), F.bool_or(F.rlike(F.trim("s"), F.lit(r"(?i)^total\b"))).alias("total"), texts.alias("texts"))
    name = F.get(F.filter("texts", lambda x: (x["col"] > F.col("account.col")) & (x["s"] != "")), 0)["s"]
    accounts = accounts.filter(F.col("account").isNotNull() & ~F.col("total")).select(*SHEET, "row", F.col("account.s").alias("number"), name.alias("title"))
    rows = entry.join(accounts, [*SHEET, "row"], "full")
    date = to_iso_date("post_date")
    # An entry's own row never opens an account.
    opened = F.when(date.isNull() & F.col("number").isNotNull(), F.struct("number", "title"))
    carried = F.last(opened, ignorenulls=True).over(Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    text = lambda n: F.when(F.col(n) != "", F.col(n)).alias(n)
    return rows.withColumn("at", carried).filter(date.isNotNull()).select(
        *SHEET, "row", F.col("at.number").alias("account"), F.col("at.title").alias("account_name"), date.alias("post_date"), text("invoice"), text("reference"),
        text("detail_description"), to_number("debit").alias("debit"), to_number("credit").alias("credit"), text("jeid"), text("invoice_no"), text("source"),
    )


def ledger_period(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, start, end from the title's 'From … to …'."""
    body = cells.join(is_ledger(cells), [*SHEET]).filter("row < header")
    pattern = r"From (\d{1,2}/\d{1,2}/\d{4}) to (\d{1,2}/\d{1,2}/\d{4})"
    title = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "col", "s"))), lambda x: x["s"]), " ")
    found = body.groupBy(*SHEET).agg(title.alias("title")).filter(F.rlike("title", F.lit(pattern)))
    return found.select(*SHEET, *[to_iso_date(F.regexp_extract("title", pattern, i)).alias(n) for i, n in ((1, "start"), (2, "end"))])


def normalizer(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, normalizer: the ledger's where it fits, else the generic one where there is a header."""
    named = is_ledger(cells).select(*SHEET, F.lit("ledger").alias("named"))
    return named.join(header_rows(cells), [*SHEET], "full").select(*SHEET, F.coalesce("named", F.lit("generic")).alias("normalizer"))


def describe(table: DataFrame, types: dict[str, str], file: str, sheet: str, context: str, order: str) -> DataFrame:
    """One text on a table: columns, rows, dates, five sample rows."""
    date = next((c for c, t in types.items() if t == "date"), None)
    sample = table.orderBy(order).limit(5).select(F.struct(F.col(order).alias("o"), row_text(list(types)).alias("t")).alias("r"))
    sample = sample.agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: F.concat(F.lit("- "), r["t"])), "\n").alias("sample"))
    span = F.when(F.min(date).isNotNull(), F.concat(F.lit("Dates from "), F.min(date).cast("string"), F.lit(" to "), F.max(date).cast("string"), F.lit("."))) if date else F.lit(None).cast("string")
    columns = ", ".join(f"{c} ({t})" for c, t in types.items())
    head = table.agg(F.count("*").alias("n"), span.alias("dates"))
    lines = [F.lit(f'Spreadsheet "{file}", sheet "{sheet}" ({context}).'), F.concat(F.col("n").cast("string"), F.lit(f" rows. Columns: {columns}.")), F.col("dates"), F.lit("Sample rows:"), F.when(F.col("sample") != "", F.col("sample"))]
    return head.crossJoin(F.broadcast(sample)).select(F.concat_ws("\n", *lines).alias("description"))


def row_sections(table: DataFrame, columns: list[str], sheet: str, order: str, most: int = 200, size: int = 25) -> DataFrame:
    """heading, text for each 25 rows of a table of at most 200; larger tables give none."""
    small = table.limit(most + 1).withColumn("__all", F.count("*").over(Window.partitionBy())).filter(F.col("__all") <= most)
    numbered = small.withColumn("__n", F.row_number().over(Window.orderBy(order)) - 1).withColumn("part", F.floor(F.col("__n") / size))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", row_text(columns).alias("t")))), lambda r: r["t"]), "\n")
    heading = F.concat(F.lit(f"{sheet} rows "), (F.min("__n") + 1).cast("string"), F.lit("-"), (F.max("__n") + 1).cast("string"))
    return numbered.groupBy("part").agg(heading.alias("heading"), lines.alias("text")).orderBy("part").drop("part")


def write_tidy(table: DataFrame, path: str) -> None:
    """Writes a table as Parquet; an empty one is refused."""
    if not table.limit(1).count():
        raise ValueError("a tidy table needs rows")
    table.write.mode("overwrite").parquet(path)
