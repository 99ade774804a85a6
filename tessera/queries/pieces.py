"""Operators of a pipeline one by one: names, pages, registry, state changes, files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates, numbers, text, vectors
from tessera.operators import planned, search, sheets, state
from tessera.plans import measure
from tessera.plans.filters import And, Eq, HasEntity, Layout, Or, Overlaps, compile_filter, dataset_period, in_scope
from tessera.queries.base import dealt, query, table
from tessera.queries.retrieval import COSINE, asked
from tessera.queries.texts import WORDS
from tessera.sources import console, readers
from tessera.sources.shared import shared_path

# Names and texts


@query("SELECT p_partkey, array_to_string(list_filter([p_brand, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END], lambda x: x IS NOT NULL AND x <> ''), ' › ') AS header FROM part")
def context_headers(spark, sf):
    rows = table(spark, sf, "part").withColumns({"type": F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")), "name": F.when(F.col("p_size") % 3 != 0, F.col("p_name"))})
    return rows.select("p_partkey", dates.context_header("p_brand", "type", "name").alias("header"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || ' to ' || strftime(o_orderdate + INTERVAL 6 DAY, '%Y-%m-%d') END AS period FROM orders")
def period_displays(spark, sf):
    first = F.to_date("o_orderdate")
    last = F.date_add(first, F.when(F.col("o_custkey") % 2 == 0, 0).otherwise(6))
    return table(spark, sf, "orders").select("o_orderkey", dates.period_display(first, last).alias("period"))


@query("SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS text FROM pages")
def markup_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.markup_text("html").alias("text"))


@query(r"SELECT p_partkey, '| a\|b | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' & ' || p_brand || ' |  |' AS markdown FROM part")
def tables_to_markdown(spark, sf):
    """Tables of a page as markdown: bars escaped, entities read, a short row filled up."""
    page = F.concat(F.lit("<p>x</p><table class=t><tr><th>a|b</th><th>size</th></tr><tr><td>"), "p_name", F.lit(" &amp; <b>"), "p_brand", F.lit("</b></td></tr></table>"))
    rows = dealt(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    return rows.select("p_partkey", text.markdown_table(F.get(text.html_tables(page), 0)).alias("markdown"))


@query("SELECT conv_id, turn, replace(replace(replace(text, 'Bearer and', '[redacted]'), 'and', '[redacted]'), 'the', '[redacted]') AS shown FROM conversations")
def redacted_texts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.redact("text", {"authorization": "Bearer and", "x-key": "the"}).alias("shown"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '' ELSE p_type || '|a+b|' || p_brand END AS segments FROM part")
def path_segments(spark, sf):
    """Folders below a root, decoded; null outside of it, none for the root itself."""
    inside = F.concat(F.lit("/drives/1/root:/Shared/Sales/"), F.replace("p_type", F.lit(" "), F.lit("%20")), F.lit("/a+b/"), "p_brand")
    path = F.when(F.col("p_size") % 5 == 0, "/drives/1/root:/Other/Sales/x").when(F.col("p_size") % 5 == 1, "/drives/1/root:/Shared/Sales").otherwise(inside)
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.relative_segments(path, "/Shared/Sales/"), "|").alias("segments"))


@query("SELECT p_partkey, p_brand AS first_value, p_size::VARCHAR AS second_value FROM part")
def key_rules_read(spark, sf):
    rules = text.key_rules(F.concat(F.lit("a: "), F.replace("p_brand", F.lit("#"), F.lit("#")), F.lit(", b :"), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.try_element_at(rules, F.lit("a")).alias("first_value"), F.try_element_at(rules, F.lit("b")).alias("second_value"))


@query("""SELECT o_orderkey, CASE WHEN named THEN d WHEN week THEN a WHEN odd THEN DATE '2011-01-01' ELSE DATE '2026-09-29' END AS first, CASE WHEN named THEN d WHEN week THEN CASE WHEN month(b) < month(a) THEN make_date(2012, month(b), day(b)) ELSE b END WHEN odd THEN DATE '2011-12-31' ELSE DATE '2026-09-29' END AS last,
                 CASE WHEN named THEN 'day' WHEN week THEN 'week' WHEN odd THEN 'year' END AS grain
          FROM (SELECT *, odd AND strftime(d, '%m-%d') <> '02-29' AND strftime(e, '%m-%d') <> '02-29' AS week, make_date(2011, month(d), least(day(d), CASE WHEN month(d) = 2 THEN 28 ELSE 31 END)) AS a, make_date(2011, month(e), least(day(e), CASE WHEN month(e) = 2 THEN 28 ELSE 31 END)) AS b
                FROM (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderdate + INTERVAL 6 DAY)::DATE AS e, o_custkey % 2 = 1 AS odd, o_custkey % 2 = 0 AND year(o_orderdate) >= 2000 AS named FROM orders))""")
def days_and_weeks_in_names(spark, sf):
    """'2001-05-06 x' is a day of this century, '5.6-5.12' a week of the year that a folder names; where that year lacks a day, the whole year."""
    rows, end = table(spark, sf, "orders"), F.col("o_orderdate") + F.expr("interval 6 days")
    week = F.concat(F.lit("Weekly Sales "), F.date_format("o_orderdate", "M.d"), F.lit("-"), F.date_format(end, "M.d"), F.lit(".xlsx"))
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("__Labor.xlsx"))
    odd = F.col("o_custkey") % 2 == 1
    period = dates.parse_period(F.when(odd, F.array(F.lit("Sales"), F.lit("2011"))).otherwise(F.array(F.lit("Sales"))), F.when(odd, week).otherwise(day), F.lit("2026-09-29"))
    return rows.select("o_orderkey", period.alias("p")).select("o_orderkey", F.col("p.start").alias("first"), F.col("p.end").alias("last"), F.col("p.grain").alias("grain"))


@query("SELECT o_orderkey, list_transform(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + to_months((o_custkey % 80)::INT)), INTERVAL 1 MONTH)[:60], lambda m: strftime(m, '%Y-%m')) AS months FROM orders")
def months_listed(spark, sf):
    end = F.add_months("o_orderdate", (F.col("o_custkey") % 80).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", dates.months_of(F.to_date("o_orderdate"), end).alias("months"))


@query("""SELECT * FROM (VALUES ('2024', '2025', '2024-01-01', '2025-12-31'), ('2024-02', '2024-02', '2024-02-01', '2024-02-29'), ('2024-05-03', '2024-05-01', '2024-05-01', '2024-05-03'),
          ('2025-03', '2024', '2024-01-01', '2025-03-31'), ('2024-13', '2025', NULL, NULL), ('soon', '2025', NULL, NULL), ('last month', 'last month', '2026-02-01', '2026-02-28'), ('YTD', 'ytd', '2026-01-01', '2026-03-15')) t(asked_from, asked_to, first, last)""")
def ranges_of_questions(spark, sf):
    """The ends of periods in a plan, and phrases that stand for a period."""
    import datetime as dt

    asked_for = [("2024", "2025"), ("2024-02", "2024-02"), ("2024-05-03", "2024-05-01"), ("2025-03", "2024"), ("2024-13", "2025"), ("soon", "2025"), ("last month", "last month"), ("YTD", "ytd")]
    today = dt.date(2026, 3, 15)
    found = [(a, b, *(dates.normalize_range(a, b) or (dates.resolve_relative(a, today) if a.lower() == b.lower() else None) or (None, None))) for a, b in asked_for]
    return spark.createDataFrame(found, "asked_from string, asked_to string, first string, last string")


@query("""WITH f AS (SELECT n_nationkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619::BIGINT) & 4294967295::BIGINT) AS h FROM nation)
          SELECT n_nationkey, (8 + abs(CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END) % 84)::INT AS place FROM f""")
def canvas_places(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", vectors.canvas_place("n_name").alias("place"))


@query("SELECT l_orderkey, l_linenumber, floor(l_discount * l_tax * 10000 + 0.5) / 10000 AS share FROM lineitem")
def scores_rounded(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_half_up(F.col("l_discount") * F.col("l_tax"), 4).alias("share"))


@query("SELECT p_partkey, p_brand AS department, p_type AS dataset, 'xlsx' AS file_type, DATE '2019-07-01' AS first, DATE '2019-07-31' AS last FROM part")
def metadata_from_paths(spark, sf):
    """Department and dataset by folder level, the dataset's name without its date."""
    folders = F.array("p_brand", F.concat("p_type", F.lit(" July 2019")))
    rows = table(spark, sf, "part").select("p_partkey", *dates.derive_meta(folders, F.lit("x.XLSX"), F.lit("2026-09-29"), ["department", "dataset"]))
    return rows.select("p_partkey", "department", "dataset", "file_type", F.col("period.start").alias("first"), F.col("period.end").alias("last"))


# Filters


@query("SELECT o_orderkey FROM orders WHERE (CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END)::DATE >= DATE '1996-01-01' AND o_orderdate::DATE <= DATE '1996-06-30'")
def dataset_periods(spark, sf):
    """Both ends of a dataset's period by themselves: a missing end stays out."""
    start = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders").select("o_orderkey", start.alias("period_start"), F.when(F.col("o_custkey") % 7 != 0, F.date_add(start, 30)).alias("period_end"))
    return rows.filter(dataset_period("1996-01-01", "1996-06-30")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR lower(c_mktsegment) = 'building'")
def scope_pinned(spark, sf):
    """What a filter pins on its And branches; values under Or pin nothing."""
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("dataset"), F.lit("Eastside").alias("hotel"))
    return rows.filter(in_scope(And((Eq("dataset", "BUILDING"), Or((Eq("hotel", "Westside"),)))))).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery' OR c_nationkey = 7")
def rows_with_an_entity(spark, sf):
    rows = table(spark, sf, "customer").withColumn("entities", F.array("c_mktsegment", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))))
    return rows.filter(compile_filter(Or((HasEntity("Machinery"), HasEntity("nation 7"))), Layout())).select("c_custkey")


@query("SELECT * FROM (VALUES ('SELECT 1', FALSE), ('COPY t TO ''x.csv''', TRUE), ('ATTACH ''a.db''', TRUE), ('ATTACH '':memory:''', FALSE), ('export  database ''d''', TRUE), (' insert into t values (1)', TRUE), ('drop table t', TRUE), ('with x as (select 1) select * from x', FALSE)) t(statement, refused)")
def statements_that_write(spark, sf):
    said = ["SELECT 1", "COPY t TO 'x.csv'", "ATTACH 'a.db'", "ATTACH ':memory:'", "export  database 'd'", " insert into t values (1)", "drop table t", "with x as (select 1) select * from x"]
    return spark.createDataFrame([(s, console.write_reason(s) is not None) for s in said], "statement string, refused boolean")


# Registry and state


@query("""SELECT o_orderkey AS id, 'file ' || o_custkey AS name, o_orderdate::DATE AS period_start FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_orderdate::DATE <= DATE '1997-03-31' AND (CASE WHEN o_custkey % 4 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 9 DAY END)::DATE >= DATE '1997-03-01'""")
def files_of_a_dataset(spark, sf):
    """The registry's files of a dataset that a period touches, with the names of their documents."""
    start = F.to_date("o_orderdate")
    rows = table(spark, sf, "orders")
    datasets = rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("dataset"), start.alias("period_start"), F.when(F.col("o_custkey") % 4 != 0, F.date_add(start, 9)).alias("period_end"))
    documents = rows.select(F.col("o_custkey").alias("id")).distinct().select("id", F.concat(F.lit("file "), F.col("id").cast("string")).alias("name"), F.lit("w").alias("web_url"))
    return measure.matching_files(datasets, documents, "1-Urgent", And((Overlaps("1997-03-01", "1997-03-31"),))).select("id", "name", "period_start")


@query("SELECT o_custkey AS item_id, CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderkey % 3 = 0 THEN 'unchanged' ELSE 'indexed' END AS outcome, count(*) AS n FROM orders GROUP BY ALL")
def outcomes_of_ingest(spark, sf):
    """What becomes of files that come again: the same hash is left as it is, errors and unknown kinds count as such."""
    rows = table(spark, sf, "orders")
    key = [F.lit("s").alias("source_id"), F.col("o_orderkey").cast("string").alias("item_id")]
    now = F.sha2("o_orderpriority", 256)
    old = rows.select(*key, F.when(F.col("o_orderkey") % 3 == 0, now).otherwise("other").alias("content_hash"), F.lit("indexed").alias("status"))
    new = rows.select(*key, now.alias("content_hash"), F.when(F.col("o_orderkey") % 11 == 0, "broken").alias("error"), (F.col("o_orderkey") % 7 == 0).alias("unsupported"), "o_custkey")
    return state.split_by_hash(new, old).groupBy(F.col("o_custkey").alias("item_id"), "outcome").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS made FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_linenumber <= 2")
def contents_replaced(spark, sf):
    """Rows of documents that come anew take the place of all their old ones."""
    old = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("made"))
    new = old.filter("l_orderkey % 5 = 0 AND l_linenumber <= 2").withColumn("made", F.lit("new"))
    return state.replace_content(old.join(new.select("l_orderkey").distinct().unionByName(old.filter("l_orderkey % 5 <> 0").select("l_orderkey").distinct()), "l_orderkey", "left_semi"), new, "l_orderkey").select("l_orderkey", "l_linenumber", "made")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'kept' ELSE 'added' END AS origin FROM nation")
def folders_copied(spark, sf):
    """A copy that leaves rows alone that are there already."""
    every = table(spark, sf, "nation").select("n_nationkey")
    return state.insert_or_ignore(every.filter("n_nationkey % 2 = 0").withColumn("origin", F.lit("kept")), every.withColumn("origin", F.lit("added")), ["n_nationkey"])


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND (lower(c_mktsegment) = 'building' OR c_nationkey IN (1, 4)) THEN 'needs_review' WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'pending' END AS status,
                 CASE WHEN c_custkey % 2 = 0 AND (lower(c_mktsegment) = 'building' OR c_nationkey IN (1, 4)) THEN 'i1' END AS superseded_by_item FROM customer""")
def corrections_overtaken(spark, sf):
    """Approved corrections that a newer file on their dataset or one of their entities puts in doubt."""
    none = F.lit(None).cast("date")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "approved").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("superseded_by_item"),
        F.lower("c_mktsegment").alias("dataset"), F.lit(None).cast("string").alias("hotel"), F.array(F.col("c_nationkey").cast("string"), F.lit(None).cast("string")).alias("entities"), none.alias("period_start"), none.alias("period_end"),
    )
    changed = spark.createDataFrame([("i1", "Building", "Eastside", ["1", "4"])], "item_id string, dataset string, hotel string, entities array<string>").withColumns({"period_start": none, "period_end": none})
    return state.supersede(rows, changed).select("id", "status", "superseded_by_item")


@query(f"""WITH o AS (SELECT conv_id * 1000 + turn AS id, list_distinct({WORDS}) AS words FROM conversations), n AS (SELECT item_id AS id, list_distinct({WORDS}) AS words FROM benchmark),
           p AS (SELECT n.id AS a, o.id AS b, len(list_intersect(n.words, o.words)) / least(len(n.words), len(o.words)) AS overlap FROM n JOIN o ON len(n.words) > 0 AND len(o.words) > 0),
           gone AS (SELECT b FROM p WHERE overlap >= 0.6 QUALIFY row_number() OVER (PARTITION BY a ORDER BY overlap DESC, b) = 1)
           SELECT (SELECT count(*) FROM o WHERE id NOT IN (SELECT b FROM gone)) AS kept, (SELECT count(*) FROM n) AS added""")
def rules_saved(spark, sf):
    """New rules take the place of those that they mostly repeat."""
    old = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.lit(False).alias("new"))
    new = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(True).alias("new"))
    return state.save_rules(old, new).agg(F.count_if(~F.col("new")).alias("kept"), F.count_if("new").alias("added"))


# Sheets and reports


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, 'item_id: ' || item_id || '; text: ' || text AS line, count(*) OVER () AS n FROM benchmark)
          SELECT 'benchmark rows ' || (min(i) + 1) || '-' || (max(i) + 1) AS heading, string_agg(line, chr(10) ORDER BY i) AS text FROM r WHERE n <= 200 GROUP BY i // 25""")
def sections_of_rows(spark, sf):
    """A small table as texts of 25 rows; larger ones than 200 rows give none."""
    return sheets.row_sections(table(spark, sf, "benchmark"), ["item_id", "text"], "benchmark", "item_id")


@query("""SELECT 'Spreadsheet "n.xlsx", sheet "S" (Geo).' || chr(10) || count(*) || ' rows. Columns: n_name (text), n_regionkey (number).' || chr(10) || 'Sample rows:' || chr(10) ||
                 (SELECT string_agg('- n_name: ' || n_name || '; n_regionkey: ' || n_regionkey, chr(10) ORDER BY n_nationkey) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5)) AS description FROM nation""")
def sheet_described(spark, sf):
    return sheets.describe(table(spark, sf, "nation"), {"n_name": "text", "n_regionkey": "number"}, "n.xlsx", "S", "Geo", "n_nationkey")


@query("SELECT p_partkey AS doc_id, s.section, s.section_title, s.n FROM part, (VALUES (1, 'Rooms', 4::BIGINT), (2, 'Bar', 2::BIGINT)) s(section, section_title, n)")
def report_sections(spark, sf):
    """A report of two tables, each under a title in a row of its own."""
    cell = lambda row, col, s: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), s.alias("s"))
    cells = [cell(0, 0, F.lit("Rooms")), cell(1, 0, F.lit("kind")), cell(1, 1, F.lit("n")), cell(2, 0, F.col("p_brand")), cell(2, 1, F.lit("7")), cell(4, 0, F.lit("Bar")), cell(5, 0, F.lit("x")), cell(5, 3, F.col("p_type"))]
    rows = dealt(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey")
    long = rows.select(F.col("p_partkey").alias("doc_id"), F.lit("S").alias("sheet"), F.explode(F.array(*cells)).alias("c")).select("doc_id", "sheet", "c.row", "c.col", "c.s")
    return planned.sections(long).groupBy("doc_id", F.col("section").cast("int").alias("section"), "section_title").agg(F.count("*").alias("n"))


@query("SELECT metric, value, n FROM (SELECT 'Retail price' AS metric, round(sum(p_retailprice), 2) AS value, count(*) AS n FROM part UNION ALL SELECT 'Office size', round(sum(p_size), 2), count(*) FROM part)")
def metrics_of_reports(spark, sf):
    """Labelled numbers in report lines, a ligature and a word cut by a line end among them."""
    report = F.concat(F.lit("Summary\nRetail price: "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("\nOﬃce size  "), F.col("p_size").cast("string"), F.lit("\nno num-\nber here"))
    found = planned.metrics(table(spark, sf, "part").select("p_partkey", report.alias("text")), "p_partkey", "text")
    return found.groupBy("metric").agg(F.round(F.sum("value"), 2).alias("value"), F.count("*").alias("n"))


@query("SELECT floor(avg(o_totalprice) * 100 + 0.5) / 100 AS value, count(*) AS rows, year(o_orderdate)::INT AS y FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY year(o_orderdate)")
def metric_averaged(spark, sf):
    """A sum of scores becomes their average."""
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"), F.year("o_orderdate").alias("y"))
    return planned.metric_measure(rows, "2-high", "sum", "y")


@query("SELECT DISTINCT c_mktsegment AS dataset, o_orderpriority AS metric FROM orders JOIN customer ON o_custkey = c_custkey")
def metric_catalog(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("metric"))
    return planned.metric_names(rows, table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("dataset")))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(list_distinct([o_orderstatus, o_orderpriority, 'c' || o_custkey])) AS name FROM orders) GROUP BY 1 ORDER BY n DESC, name LIMIT 300")
def entities_most_named(spark, sf):
    rows = table(spark, sf, "orders").select(F.array("o_orderstatus", "o_orderpriority", F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "o_orderstatus").alias("entities"))
    return planned.frequent_entities(rows)


@query(f"""WITH s AS (SELECT vec_id FROM embeddings WHERE label <> 3 ORDER BY {COSINE.format(5)} DESC, vec_id LIMIT 20)
           SELECT vec_id * 10 + i AS id FROM embeddings, (VALUES (0), (1)) t(i) WHERE label = 3 OR vec_id IN (SELECT vec_id FROM s)""")
def chunks_of_near_summaries(spark, sf):
    """Two stages: chunks of the twenty documents with the nearest summaries, and of those without one."""
    rows = table(spark, sf, "embeddings")
    documents = rows.select(F.col("vec_id").alias("id"), F.when(F.col("label") != 3, F.col("embedding")).alias("summary_embedding"))
    chunks = rows.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), F.col("vec_id").alias("document_id")).select((F.col("document_id") * 10 + F.col("i")).alias("id"), "document_id")
    return search.two_stage(documents, chunks, asked(spark, sf, 5)).select("id")


# Files written and read back


def _stored(df, spark, name: str) -> str:
    path = shared_path(spark, name)
    df.write.mode("overwrite").format("parquet").save(path)
    return path


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tidy_round_trip(spark, sf):
    path = shared_path(spark, "tidy") + ".parquet"
    sheets.write_tidy(table(spark, sf, "nation"), path)
    return readers.read_any(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT event_id, event_type, value FROM events")
def ndjson_round_trip(spark, sf):
    path = shared_path(spark, "events")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return readers.read_ndjson(spark, path, "event_id long, event_type string, value double")


@query("SELECT c_custkey::VARCHAR AS a, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name || ', \"' || c_mktsegment || '\"' END AS b FROM customer")
def csv_round_trip(spark, sf):
    """Quotes, commas and blank fields of a CSV grid; nothing is typed."""
    path = shared_path(spark, "grid") + ".csv"
    name = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    table(spark, sf, "customer").select(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 != 0, name)).write.options(quote='"', escape='"', header=False).csv(path)
    return readers.read_csv_grid(spark, path).toDF("a", "b")


@query("SELECT 2 * count(*) AS rows, count(DISTINCT o_custkey) AS users FROM orders")
def log_appended(spark, sf):
    path = shared_path(spark, "log")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("user"), F.col("o_totalprice").alias("latency"))
    for _ in range(2):
        readers.append_log(rows, path)
    return spark.read.json(path).agg(F.count("*").alias("rows"), F.countDistinct("user").alias("users"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def datasets_as_views(spark, sf):
    """Datasets of the registry as views of the console."""
    path = _stored(table(spark, sf, "customer"), spark, "dataset")
    names = console.Console(spark)
    names.register_datasets(spark.createDataFrame([(17, path)], "id int, path string"), [17])
    return names.sql("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM kb_dataset_17 GROUP BY 1")
