"""Filters, measures, coverage, catalog, joins over the relational tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.profile import profile
from tessera.operators.search import confidence, hydrate
from tessera.operators.sketches import FileSketches, by_time, percentile_since
from tessera.operators.state import latest, missing_from, newest_facts, sweep_left_out
from tessera.plans import catalog, measure
from tessera.plans.filters import And, Eq, Layout, Not, Or, Overlaps, compile_filter, contains_pattern, under
from tessera.queries.base import query, table
from tessera.sources.shared import shared_path

DOCS = Layout(columns={"hotel": "source", "department": "lang", "dataset": "quality", "file_type": "toxic"})
TWO_YEARS = [("1996-01-01", "1996-12-31"), ("1998-01-01", "1998-12-31")]
ROUND = "floor({} * 100 + 0.5) / 100"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS value, count(*) AS rows FROM orders GROUP BY 1")
def measure_sum_by_year(spark, sf):
    rows = measure.aggregate(orders(spark, sf).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), "sum", "o_totalprice", date="o_orderdate", group_by="year")
    return rows


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS value, count(*) AS rows FROM orders GROUP BY 1")
def measure_avg_by_month(spark, sf):
    return measure.aggregate(orders(spark, sf), "avg", "o_totalprice", date="o_orderdate", group_by="month")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*)::DOUBLE AS value, count(*) AS rows FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-02-01' AND DATE '1997-04-30' GROUP BY 1")
def measure_count_by_day(spark, sf):
    return measure.aggregate(orders(spark, sf), "count", date="o_orderdate", group_by="day", periods=[("1997-02-01", "1997-04-30")])


@query("SELECT floor(min(o_totalprice) * 100 + 0.5) / 100 AS value, count(*) AS rows FROM orders HAVING count(*) > 0")
def measure_min_total(spark, sf):
    return measure.aggregate(orders(spark, sf), "min", "o_totalprice")


@query("SELECT floor(max(o_totalprice) * 100 + 0.5) / 100 AS value, count(*) AS rows FROM orders HAVING count(*) > 0")
def measure_max_total(spark, sf):
    return measure.aggregate(orders(spark, sf), "max", "o_totalprice")


@query("SELECT floor(max(o_totalprice) * 100 + 0.5) / 100 AS value, count(*) AS rows FROM orders WHERE o_orderdate < DATE '1900-01-01' HAVING count(*) > 0")
def measure_without_rows(spark, sf):
    return measure.aggregate(orders(spark, sf), "max", "o_totalprice", date="o_orderdate", periods=[("1800-01-01", "1899-12-31")])


@query("SELECT floor(sum(l_quantity) * 100 + 0.5) / 100 AS value, count(*) AS rows FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name ILIKE '%' || 'd_r' || '%' HAVING count(*) > 0")
def measure_where_text(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return measure.aggregate(rows, "sum", "l_quantity", where_text=(("p_name", "d_r"),))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS value, count(*) AS rows FROM orders
          WHERE (o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' OR o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')
            AND NOT (lower(o_orderstatus) = 'p') AND (lower(o_orderpriority) = '1-urgent' OR lower(o_orderpriority) = '2-high') GROUP BY 1""")
def measure_two_period_compare(spark, sf):
    """The flagship: a filter tree, two periods, a sum by year."""
    layout = Layout(columns={"hotel": "o_orderpriority", "department": "o_orderstatus"})
    tree = And((Or((Eq("hotel", "1-URGENT"), Eq("hotel", "2-HIGH"))), Not(Or((Eq("department", "p"),)))))
    rows = orders(spark, sf).filter(compile_filter(tree, layout))
    return measure.aggregate(rows, "sum", "o_totalprice", date="o_orderdate", group_by="year", periods=TWO_YEARS)


@query("""WITH asked AS (SELECT strftime(m, '%Y-%m') AS month FROM generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '1995-02-01', INTERVAL 1 MONTH) t(m)
                        UNION SELECT strftime(m, '%Y-%m') FROM generate_series(TIMESTAMP '2001-06-01', TIMESTAMP '2002-02-01', INTERVAL 1 MONTH) t(m)),
               present AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)
          SELECT month, month IN (SELECT month FROM present) AS present FROM asked""")
def coverage_missing_months(spark, sf):
    per = orders(spark, sf).groupBy(F.year("o_orderdate").alias("y")).agg(F.min(F.to_date("o_orderdate")).alias("period_start"), F.max(F.to_date("o_orderdate")).alias("period_end"))
    return measure.coverage(spark, [("1994-11-01", "1995-02-28"), ("2001-06-01", "2002-02-28")], measure.present_months(per))


def labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (lower(source) = 'src1' OR lower(source) = 'src2') AND lower(lang) = 'en' AND NOT (lower(toxic::VARCHAR) = '1')")
def filter_tree_and_or_not(spark, sf):
    tree = And((Or((Eq("hotel", "SRC1"), Eq("hotel", "src2"))), Eq("department", "EN"), Not(Eq("file_type", "1"))))
    return labelled(spark, sf).filter(compile_filter(tree, DOCS)).select("doc_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (lower(quality::VARCHAR) = '0')")
def filter_null_not(spark, sf):
    return labelled(spark, sf).filter(compile_filter(Not(Eq("dataset", "0")), DOCS)).select("doc_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE TRUE AND NOT FALSE GROUP BY lang")
def filter_empty_or(spark, sf):
    return table(spark, sf, "documents").filter(compile_filter(And((Or(),)), DOCS)).groupBy("lang").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events GROUP BY user_id)
          SELECT user_id FROM s WHERE a <= DATE '2024-01-12' AND coalesce(b, a) >= DATE '2024-01-10'""")
def period_overlap(spark, sf):
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("period_start"), F.to_date(F.max("ts")).alias("period_end"))
    return spans.filter(compile_filter(Overlaps("2024-01-10", "2024-01-12"))).select("user_id")


@query("SELECT count(*) AS n, min(url) AS first FROM pages WHERE left(url, length(split_part(url, '/', 3)) + 9) = 'https://' || split_part(url, '/', 3) || '/'")
def subtree_prefix(spark, sf):
    host = F.concat(F.lit("https://"), F.split_part("url", F.lit("/"), F.lit(3)))
    return table(spark, sf, "pages").filter(under("url", host)).agg(F.count("*").alias("n"), F.min("url").alias("first"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def catalog_distincts(spark, sf):
    return catalog.distinct_values(table(spark, sf, "documents"), "source")


@query("SELECT event_type AS name, min(user_id) AS department, min(ts)::DATE AS \"from\", max(ts)::DATE AS \"to\", count(*) AS files FROM events GROUP BY 1")
def catalog_datasets(spark, sf):
    events = table(spark, sf, "events")
    docs = events.select(F.lit("indexed").alias("status"), F.col("event_type").alias("dataset"), F.col("user_id").alias("department"), F.to_date("ts").alias("period_start"), F.to_date("ts").alias("period_end"))
    none = spark.createDataFrame([], "dataset string, period_end date, id long, columns array<string>")
    return catalog.dataset_summary(docs, none).drop("columns")


@query("SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id DESC) = 1")
def catalog_latest_per_dataset(spark, sf):
    return catalog.latest_per(table(spark, sf, "events"), "event_type", "ts", "event_id").select("event_type", "event_id", "user_id")


@query("""SELECT event_id AS id, event_type AS dataset, ts::DATE AS period_start FROM events WHERE lower(event_type) = 'purchase' AND ts::DATE >= DATE '2024-01-05'
          AND ts::DATE <= DATE '2024-01-20' ORDER BY ts::DATE, event_id LIMIT 200""")
def catalog_listing(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("dataset"), F.col("event_id").alias("document_id"), F.to_date("ts").alias("period_start"), F.to_date("ts").alias("period_end"))
    names = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("web_url"))
    return catalog.list_datasets(events, names, dataset="Purchase", start="2024-01-05", end="2024-01-20").select("id", "dataset", "period_start")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def status_counts_pivot(spark, sf):
    return catalog.status_counts(orders(spark, sf), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]).na.fill(0)


@query("""SELECT s.id, c.n AS docs FROM (SELECT DISTINCT source AS id FROM documents) s LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY 1) c ON s.id = c.source""")
def source_overview(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("status"))
    sources = docs.select(F.col("source_id").alias("id")).distinct()
    state = spark.createDataFrame([], "source_id string, cursor string")
    return catalog.source_overview(sources, docs, state).select("id", F.try_element_at("counts", F.lit("fr")).alias("docs"))


@query("SELECT coalesce(quantile_cont(value, 0.95), 0) AS p FROM events WHERE ts > (SELECT max(ts) - INTERVAL 1 DAY FROM events) AND event_type IS DISTINCT FROM 'error'")
def latency_p95_trailing(spark, sf):
    return catalog.trailing_percentile(table(spark, sf, "events"), "ts", "value", interval="1 day", user="event_type", without="error")


@query("""SELECT 'c_custkey' AS column_name, min(c_custkey)::VARCHAR AS min, max(c_custkey)::VARCHAR AS max, round(avg(c_custkey), 6) AS avg, round(stddev_samp(c_custkey), 6) AS std, count(*) AS count, 100.0::DOUBLE * (count(*) - count(c_custkey)) / count(*) AS null_percentage FROM customer
          UNION ALL SELECT 'c_mktsegment', min(c_mktsegment), max(c_mktsegment), NULL, NULL, count(*), 100.0::DOUBLE * (count(*) - count(c_mktsegment)) / count(*) FROM customer
          UNION ALL SELECT 'c_nationkey', min(c_nationkey)::VARCHAR, max(c_nationkey)::VARCHAR, round(avg(c_nationkey), 6), round(stddev_samp(c_nationkey), 6), count(*), 100.0::DOUBLE * (count(*) - count(c_nationkey)) / count(*) FROM customer""")
def table_profile_exact(spark, sf):
    out = profile(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), approximate=False)
    return out.withColumns({"avg": F.round("avg", 6), "std": F.round("std", 6)}).drop("column_type")


@query()
def table_profile_approx(spark, sf):
    return profile(orders(spark, sf))


@query("""SELECT 'o_custkey' AS column_name, count(*) AS count, min(o_custkey)::DOUBLE AS low, max(o_custkey)::DOUBLE AS high, round(avg(o_custkey), 4) AS avg, round(stddev_samp(o_custkey), 4) AS std, TRUE AS unique_close, TRUE AS quartiles_close FROM orders
          UNION ALL SELECT 'o_totalprice', count(*), min(o_totalprice), max(o_totalprice), round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4), TRUE, TRUE FROM orders
          UNION ALL SELECT 'o_orderpriority', count(*), NULL, NULL, NULL, NULL, TRUE, NULL FROM orders""")
def profile_of_files(spark, sf):
    """A profile merged from sketches of a year's file each: distinct values within 5 %, quartiles within 2 % of their rank."""
    path = shared_path(spark, "profiled")
    rows = orders(spark, sf).select("o_custkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("year"))
    rows.repartition("year").write.partitionBy("year").parquet(f"{path}/orders")
    files = spark.read.parquet(f"{path}/orders").drop("year")
    found = FileSketches(spark, f"{path}/sketches").profile(files)
    quartiles = {r["column_name"]: (r["q25"], r["q50"], r["q75"]) for r in found.collect()}  # a row a column
    true = []
    for name, ends in quartiles.items():
        ranks = [F.abs(F.avg((F.col(name) <= q).cast("double")) - r) <= 0.02 for q, r in zip(ends, (0.25, 0.5, 0.75), strict=True)] if ends[0] is not None else [F.lit(None).cast("boolean")]
        true.append(F.struct(F.lit(name).alias("name"), F.count_distinct(name).alias("distinct"), reduce(and_, ranks).alias("quartiles_close")))
    exact = files.agg(F.array(*true).alias("x")).select(F.inline("x"))
    out = found.join(exact, F.col("column_name") == F.col("name"))
    close = F.abs(F.col("approx_unique") - F.col("distinct")) <= 0.05 * F.col("distinct")
    return out.select("column_name", "count", F.col("min").try_cast("double").alias("low"), F.col("max").try_cast("double").alias("high"), F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"), close.alias("unique_close"), "quartiles_close")


@query("""WITH e AS (SELECT * FROM events WHERE event_type <> 'error'), last AS (SELECT * FROM e WHERE ts >= (SELECT date_trunc('hour', max(ts)) - INTERVAL 5 DAY FROM events))
          SELECT count(*) AS n, TRUE AS close FROM last""")
def latency_p95_sketched(spark, sf):
    """The 95th percentile of the last days from a sketch an hour: within 2 % of its rank."""
    rows = table(spark, sf, "events").filter("event_type <> 'error'")
    newest = table(spark, sf, "events").agg((F.date_trunc("hour", F.max(F.col("ts").cast("timestamp"))) - F.expr("interval 5 days")).alias("since"))
    since = newest.first()["since"]
    found = percentile_since(by_time(rows, "ts", "value", "1 hour"), F.lit(since), 0.95)
    below = rows.filter(F.col("ts").cast("timestamp") >= F.lit(since)).crossJoin(F.broadcast(found))  # one row
    return below.groupBy("n").agg((F.abs(F.avg((F.col("value") <= F.col("percentile")).cast("double")) - 0.95) <= 0.02).alias("close"))


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL BY NAME SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def union_by_name_mixed(spark, sf):
    a = table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    b = table(spark, sf, "customer").selectExpr("c_mktsegment AS segment", "c_custkey AS key", "c_acctbal AS balance", "c_name AS name")
    return measure.union_by_name([a, b])


@query("""SELECT l_orderkey, l_linenumber, o_orderdate::DATE::VARCHAR AS day, c_name FROM (SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 80)
          JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def late_materialize_hydrate(spark, sf):
    best = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(80)
    out = hydrate(best.withColumnRenamed("l_orderkey", "o_orderkey"), (orders(spark, sf).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate"), "o_orderkey"), (table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey"))
    return out.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", F.to_date("o_orderdate").cast("string").alias("day"), "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < DATE '1995-06-01')")
def anti_join_rebuild(spark, sf):
    return missing_from(table(spark, sf, "customer").select("c_custkey"), orders(spark, sf).filter("o_orderdate < timestamp_ntz '1995-06-01'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_mktsegment, count(*) AS swept FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def mark_sweep(spark, sf):
    seen = orders(spark, sf).filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sweep_left_out(table(spark, sf, "customer"), seen, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("swept"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations")
def forward_fill_account(spark, sf):
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(window).alias("asked"))


@query("""SELECT p_partkey, CASE WHEN n > 1 THEN p_brand || '_' || n ELSE p_brand END AS name FROM
          (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS n FROM part)""")
def dup_header_suffix(spark, sf):
    from tessera.operators.sheets import unique_names

    return unique_names(table(spark, sf, "part").withColumn("name", F.col("p_brand")), ("p_type",), "name", "p_partkey").select("p_partkey", "name")


@query("""SELECT conv_id, min(turn) AS header FROM (SELECT *, max((length(text) >= 40)::INT) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM conversations)
          WHERE role = 'user' AND ahead = 1 GROUP BY 1""")
def header_lookahead(spark, sf):
    ahead = F.max((F.length("text") >= 40).cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, 3))
    return table(spark, sf, "conversations").withColumn("ahead", ahead).filter("role = 'user' and ahead = 1").groupBy("conv_id").agg(F.min("turn").alias("header"))


FACTS = "SELECT o_orderkey AS id, o_custkey AS node_id, o_orderdate AS created FROM orders"


@query(f"SELECT id, node_id FROM ({FACTS}) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY created DESC, id DESC) <= 4")
def top4_per_node(spark, sf):
    facts = orders(spark, sf).selectExpr("o_orderkey AS id", "o_custkey AS node_id", "o_orderdate AS created")
    return newest_facts(facts).select("id", "node_id")


@query("""WITH hits AS (SELECT c_custkey AS node_id, c_acctbal AS score FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0),
               direct AS (SELECT o_orderkey AS id, o_totalprice / 100 AS base FROM orders WHERE o_totalprice > 40000),
               newest AS (SELECT o_orderkey AS id, o_custkey AS node_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 4),
               every AS (SELECT id, base FROM direct UNION ALL SELECT id, score * 0.8::DOUBLE FROM newest JOIN hits USING (node_id))
          SELECT id, round(max(base), 4) AS score FROM every GROUP BY id""")
def one_hop_expand(spark, sf):
    facts = orders(spark, sf).selectExpr("o_orderkey AS id", "o_custkey AS node_id", "o_orderdate AS created")
    direct = orders(spark, sf).filter("o_totalprice > 40000").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100).alias("base"))
    named = table(spark, sf, "customer").filter("c_nationkey = 3 and c_acctbal > 0").select(F.col("c_custkey").alias("node_id"), (F.col("c_acctbal") * 0.8).alias("base"))
    return direct.unionByName(newest_facts(facts).join(named, "node_id").select("id", "base")).groupBy("id").agg(F.round(F.max("base"), 4).alias("score"))


@query("""WITH x AS (SELECT o_custkey, count(*) AS found, count(*) FILTER (o_orderstatus = 'P') AS missing, count(*) FILTER (o_totalprice < 2000) AS notes FROM orders GROUP BY 1),
               k AS (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'numeric' ELSE 'passages' END AS kind FROM x),
               s AS (SELECT *, CASE WHEN kind = 'numeric' THEN CASE WHEN found = 0 THEN 0 WHEN missing > 0 THEN 1 ELSE 2 END ELSE CASE WHEN found >= 3 THEN 2 WHEN found >= 1 THEN 1 ELSE 0 END END AS step FROM k)
          SELECT o_custkey, ['low', 'medium', 'high'][greatest(0, step - CASE WHEN notes > 0 THEN 1 ELSE 0 END) + 1] AS confidence FROM s""")
def confidence_case(spark, sf):
    per = orders(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("found"), F.count_if(F.col("o_orderstatus") == "P").alias("missing"), F.count_if(F.col("o_totalprice") < 2000).alias("notes"))
    kind = F.when(F.col("o_custkey") % 2 == 0, "numeric").otherwise("passages")
    return per.select("o_custkey", confidence(kind, "found", "missing", "notes").alias("confidence"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_extract_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def sql_console(spark, sf):
    from tessera.sources.console import Console

    return Console(spark).sql(f"SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM read_parquet('{sf}/orders.parquet') WHERE o_orderstatus = 'F' GROUP BY ALL")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '%' || 'NOT SPEC' || '%'")
def substring_ilike(spark, sf):
    return orders(spark, sf).filter(contains_pattern("o_orderpriority", "NOT SPEC")).select("o_orderkey")


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_id, count(*) FILTER (o_orderstatus = 'P') AS errors FROM orders")
def next_id_and_errors(spark, sf):
    return orders(spark, sf).agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_id"), F.count_if(F.col("o_orderstatus") == "P").alias("errors"))


@query("""SELECT coalesce(a.source, b.source) AS source_id, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS indexed FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) a
          FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY 1) b ON a.source = b.source WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def reconcile_counts(spark, sf):
    docs = table(spark, sf, "documents")
    sources = docs.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("expected"))
    return catalog.reconcile(sources, docs.select(F.col("source").alias("source_id"), F.when(F.col("lang") != "de", "indexed").alias("status")))


@query("SELECT event_id, event_type FROM events ORDER BY (event_type = 'error') DESC, event_id DESC LIMIT 10")
def recent_errors_first(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type").orderBy((F.col("event_type") == "error").desc(), F.col("event_id").desc()).limit(10)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_change_per_key(spark, sf):
    return latest(table(spark, sf, "events"), ("user_id",), ("ts", "event_id")).select("user_id", "event_id")
