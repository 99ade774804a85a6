"""Upserts, deletes, renames, corrections, memory: new snapshots from old ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sheets, state
from tessera.queries.base import query, table
from tessera.streaming.cdc import apply_changes, latest_per_interval, recent, skip_unchanged


def changes(spark, sf):
    """Events as changes: an item is a user, a version a time, an error a tombstone."""
    return table(spark, sf, "events").select(F.col("user_id").alias("id"), "ts", "event_id", "value", (F.col("event_type") == "error").alias("deleted"))


@query("SELECT user_id AS id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest_wins(spark, sf):
    return state.latest(changes(spark, sf), ("id",), ("ts", "event_id")).select("id", "event_id", "value")


@query("""WITH half AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'), rest AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
               a AS (SELECT user_id, event_id, value FROM (SELECT * FROM half QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'),
               b AS (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
          SELECT user_id AS id, event_id, value FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT user_id, event_id, value FROM b WHERE event_type <> 'error'""")
def cdc_tombstones(spark, sf):
    rows = changes(spark, sf)
    first, second = rows.filter("ts < timestamp_ntz '2024-01-16'"), rows.filter("ts >= timestamp_ntz '2024-01-16'")
    empty = rows.limit(0).select("id", "event_id", "value")
    order = ("ts", "event_id")
    return apply_changes(apply_changes(empty, first, "id", order, "deleted"), second, "id", order, "deleted")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), r AS (SELECT split_part(min(path), '/', 1) AS host FROM p)
          SELECT page_id, CASE WHEN starts_with(path, host || '/') THEN 'moved' || substr(path, length(host) + 1) ELSE path END AS path, starts_with(path, host || '/') AS retagged FROM p, r""")
def rename_retag(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    host = rows.agg(F.split_part(F.min("path"), F.lit("/"), F.lit(1))).head()[0]
    return state.rename_folder(rows, host, "moved")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), f AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder FROM p WHERE contains(path, '/fr/'))
          SELECT page_id FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE starts_with(path, folder || '/'))""")
def delete_subtree(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("item_id"), F.regexp_replace("url", "^https?://", "").alias("path"))
    folder = F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2)))
    items = rows.filter(F.contains("path", F.lit("/fr/"))).select(F.lit("none").alias("item_id"), folder.alias("path"), F.lit(True).alias("is_folder")).distinct()
    return state.delete_items(rows, items).select(F.col("item_id").cast("long").alias("page_id"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < DATE '1999-01-01'), n AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-01-01')
          SELECT coalesce(n.o_orderkey, o.o_orderkey) AS item, CASE WHEN n.o_orderkey IS NOT NULL THEN CASE n.o_orderstatus WHEN 'P' THEN 'error' ELSE 'indexed' END ELSE 'indexed' END AS status,
                 CASE WHEN n.o_orderkey IS NOT NULL THEN CASE WHEN n.o_orderstatus = 'P' THEN CASE WHEN o.o_orderkey IS NOT NULL THEN 3 ELSE 1 END ELSE 0 END ELSE 2 END AS attempts,
                 CASE WHEN n.o_orderkey IS NOT NULL AND n.o_orderstatus <> 'P' THEN 'new' ELSE CASE WHEN o.o_orderkey IS NOT NULL THEN 'old' END END AS indexed FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def upsert_documents(spark, sf):
    rows = table(spark, sf, "orders")
    make = lambda df, status, attempts: df.select(F.lit("s").alias("source_id"), F.col("o_orderkey").alias("item_id"), status.alias("status"), F.col("o_orderpriority").alias("content_hash"), F.lit(attempts).alias("attempts"), F.lit("old").alias("indexed_at"))
    old = make(rows.filter("o_orderdate < timestamp_ntz '1999-01-01'"), F.lit("indexed"), 2)
    new = make(rows.filter("o_orderdate >= timestamp_ntz '1998-01-01'"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("indexed"), 0).drop("attempts", "indexed_at")
    out = state.upsert_documents(old, new, F.lit("new"))
    return out.select(F.col("item_id").alias("item"), "status", "attempts", F.col("indexed_at").alias("indexed"))


@query("""WITH k AS (SELECT user_id, max(ts) AS at, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
          SELECT e.event_id FROM events e LEFT JOIN k USING (user_id) WHERE NOT coalesce(e.ts = k.at, FALSE)""")
def skip_unchanged_tags(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("ctag"), "event_id", "event_type")
    known = events.filter("event_type = 'view'").groupBy("id").agg(F.max("ctag").alias("ctag"))
    return skip_unchanged(events, known).select("event_id")


def corrections(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    scope = F.when(F.col("quality") == 1, "global").otherwise("personal")
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "approved", "needs_review", "active", "rejected", "expired")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return rows.select(F.col("doc_id").alias("id"), F.col("source").alias("author"), scope.alias("scope"), status.alias("status"), F.expr("timestamp '2024-01-01' + make_dt_interval(cast(doc_id % 300 AS int))").alias("created_at"))


CORRECTIONS = """WITH c AS (SELECT doc_id AS id, source AS author, CASE WHEN quality = 1 THEN 'global' ELSE 'personal' END AS scope,
    ['pending', 'approved', 'needs_review', 'active', 'rejected', 'expired'][doc_id % 6 + 1] AS status, TIMESTAMP '2024-01-01' + (doc_id % 300)::INT * INTERVAL 1 DAY AS created_at FROM labels JOIN documents USING (doc_id))"""


@query(CORRECTIONS + "SELECT id FROM c WHERE (scope = 'global' AND status IN ('approved', 'needs_review')) OR (author = 'src3' AND status NOT IN ('rejected', 'expired', 'superseded'))")
def visible_corrections(spark, sf):
    return state.visible(corrections(spark, sf), "src3").select("id")


@query(CORRECTIONS + "SELECT id, status FROM c WHERE author = 'src3' OR (scope = 'global' AND status <> 'pending')")
def reviewable_corrections(spark, sf):
    return state.reviewable(corrections(spark, sf), "src3").select("id", "status")


@query(CORRECTIONS + """, t AS (SELECT *, CASE WHEN scope = 'personal' THEN created_at + INTERVAL 90 DAY END AS expires_at, CASE WHEN scope = 'global' THEN created_at + INTERVAL 180 DAY END AS review_due_at FROM c)
    SELECT id, CASE WHEN status IN ('active', 'approved', 'needs_review') AND expires_at <= TIMESTAMP '2024-09-01' THEN 'expired' WHEN status = 'approved' AND review_due_at <= TIMESTAMP '2024-09-01' THEN 'needs_review' ELSE status END AS status FROM t""")
def expire_corrections(spark, sf):
    return state.expire(state.with_terms(corrections(spark, sf)), F.lit("2024-09-01").cast("timestamp")).select("id", "status")


@query("""WITH o AS (SELECT conv_id AS node_id, text, min(turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1, 2), k AS (SELECT DISTINCT node_id, trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[.!\\s]+$', '')) AS same FROM o),
          n AS (SELECT conv_id AS node_id, trim(regexp_replace(regexp_replace(lower(text || '.'), '\\s+', ' ', 'g'), '[.!\\s]+$', '')) AS same FROM conversations WHERE role <> 'system' GROUP BY 1, 2)
          SELECT node_id, (SELECT count(*) FROM o WHERE o.node_id = x.node_id) + count(*) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.node_id = x.node_id AND k.same = x.same)) AS facts FROM n x GROUP BY 1""".replace("\\\\", "\\"))
def memory_add_facts(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("node_id"), "text", "role", F.lit("2024-01-01").cast("timestamp").alias("created"))
    old = rows.filter("role = 'user'").dropDuplicates(["node_id", "text"]).drop("role")
    new = rows.filter("role != 'system'").withColumn("text", F.concat("text", F.lit("."))).drop("role")
    return state.add_facts(old, new).groupBy("node_id").agg(F.count("*").alias("facts"))


@query("SELECT DISTINCT least(o_custkey, c_nationkey) AS a, greatest(o_custkey, c_nationkey) AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey <> c_nationkey")
def memory_edges(spark, sf):
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    links = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    links = links.select(F.col("o_custkey").alias("a"), F.lower("n_name").alias("label"))
    return state.add_edges(spark.createDataFrame([], "a long, b long"), links, nodes)


@query("SELECT c_nationkey AS node_id, list(c_name ORDER BY c_custkey) AS facts FROM customer GROUP BY 1")
def facts_by_node(spark, sf):
    return state.facts_by_node(table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey AS node_id", "c_name AS text"))


@query("""WITH b AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events)
          SELECT event_id FROM b QUALIFY row_number() OVER (PARTITION BY w, event_type ORDER BY ts DESC) = 1""")
def throttled_updates(spark, sf):
    return latest_per_interval(table(spark, sf, "events"), "event_type", "ts", "1 hour").select("event_id")


@query("SELECT event_id, ts::DATE AS day FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def recent_ring(spark, sf):
    return recent(table(spark, sf, "events"), "ts", "event_id").select("event_id", F.to_date("ts").alias("day"))


@query("""SELECT o_orderkey AS entry, 'A' || o_custkey AS account, o_orderdate::DATE AS post_date, CASE WHEN o_orderstatus <> 'F' THEN round(o_totalprice, 2) END AS debit, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 2) END AS credit FROM orders""")
def ledger_normalize(spark, sf):
    """All orders laid out as ledger reports, one sheet a customer, and read back."""
    o = table(spark, sf, "orders")
    amount = F.format_number("o_totalprice", 2)
    head = o.select(F.col("o_custkey").cast("string").alias("doc_id")).distinct()
    cell = lambda df, row, col, s: df.select("doc_id", F.lit("s").alias("sheet"), row.cast("int").alias("row"), F.lit(col).alias("col"), s.alias("s"))
    parts = [cell(head, F.lit(0), 3, F.lit("General Ledger Activity Detail")), cell(head, F.lit(3), 0, F.concat(F.lpad("doc_id", 5, "0"), F.lit(".000"))), cell(head, F.lit(3), 3, F.concat(F.lit("A"), "doc_id"))]
    parts += [cell(head, F.lit(2), i, F.lit(t)) for i, t in ((1, "Post Date"), (2, "Reference"), (4, "Debit"), (5, "Credit "))]
    rows = o.withColumn("doc_id", F.col("o_custkey").cast("string"))
    at = F.col("o_orderkey") + 4
    parts += [cell(rows, at, 1, F.date_format("o_orderdate", "M/d/yyyy")), cell(rows, at, 2, F.col("o_orderkey").cast("string"))]
    parts += [cell(rows.filter("o_orderstatus != 'F'"), at, 4, amount), cell(rows.filter("o_orderstatus = 'F'"), at, 5, amount)]
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    out = sheets.ledger(cells)
    return out.select(F.col("reference").cast("long").alias("entry"), F.col("account_name").alias("account"), "post_date", "debit", "credit")


@query("""SELECT 'customer_key' AS name, 'number' AS type, count(*) AS filled FROM customer UNION ALL SELECT 'customer_key_2', 'text', count(*) FROM customer
          UNION ALL SELECT 'col_4', 'number', count(*) FILTER (c_acctbal > 0) FROM customer UNION ALL SELECT 'since', 'date', count(*) FROM customer""")
def sheet_generic(spark, sf):
    """Customers as a sheet of strings with a title, repeated and missing headings; names and types inferred."""
    c = table(spark, sf, "customer")
    cell = lambda df, row, col, s: df.select(F.lit("d").alias("doc_id"), F.lit("s").alias("sheet"), row.cast("int").alias("row"), F.lit(col).alias("col"), s.alias("s"))
    one = spark.range(1)
    cells = cell(one, F.lit(0), 0, F.lit("Customers"))
    for i, t in ((0, "Customer Key"), (1, "Customer Key"), (4, "Since")):
        cells = cells.unionByName(cell(one, F.lit(2), i, F.lit(t)))
    at = F.col("c_custkey") + 3
    for i, rows, s in ((0, c, F.col("c_custkey").cast("string")), (1, c, F.col("c_name")), (3, c.filter("c_acctbal > 0"), F.concat(F.lit("$"), F.format_number("c_acctbal", 2))), (4, c, F.lit("8/1/2026"))):
        cells = cells.unionByName(cell(rows, at, i, s))
    values = sheets.tidy_values(cells)
    return values.groupBy("name", "type").agg(F.count(F.coalesce(F.col("number").cast("string"), F.col("date").cast("string"), F.col("text"))).alias("filled"))
