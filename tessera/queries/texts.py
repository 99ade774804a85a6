"""String, number, date and page functions over the tables' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates, numbers, text, vectors
from tessera.operators import state
from tessera.operators.chunk import chunk_documents, windows_of
from tessera.operators.matching import contained, similar_classes
from tessera.operators.profile import best_match, similar_pairs
from tessera.queries.base import query, table

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
WORDS = rf"list_filter(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''’-]*'), lambda w: regexp_replace(w, '[''’]s$', '')), lambda w: length(w) > 1 AND NOT list_contains([{STOP}], w))"


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct({WORDS})), ' ') AS words FROM benchmark")
def keywords_extract(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(text.keywords("text")), " ").alias("words"))


@query(r"SELECT trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[.!\s]+$', '')) AS fact, count(*) AS n FROM conversations GROUP BY 1")
def norm_text_dedupe(spark, sf):
    return table(spark, sf, "conversations").groupBy(text.normal_fact("text").alias("fact")).agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_type || ' (' || p_brand || ')''s'), '[''’]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name,
                  regexp_replace(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9.!_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS part FROM part""")
def snake_slug(spark, sf):
    name, part = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")'s")), F.concat_ws(" / ", "p_type", "p_brand")
    return table(spark, sf, "part").select("p_partkey", text.snake(name).alias("name"), text.slug(part).alias("part"))


@query(r"""WITH t AS (SELECT o_orderkey, concat_ws(' ', o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'), 'report', strftime(o_orderdate, '%m.%Y')) AS s FROM orders)
           SELECT o_orderkey, trim(array_to_string(list_filter(string_split(regexp_replace(s, '20[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[.]20[0-9]{2}|\b20[0-9]{2}\b', ' ', 'g'), ' '), lambda w: w <> ''), ' '), ' _-–.') AS name FROM t""")
def strip_dates(spark, sf):
    name = F.concat_ws(" ", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("report"), F.date_format("o_orderdate", "MM.yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", dates.strip_dates(name).alias("name"))


@query(r"""WITH m AS (SELECT event_type, 'failed req_' || user_id || CASE event_id % 3 WHEN 0 THEN '_def' WHEN 1 THEN ' myreq_abc1' ELSE ' deadBEEF99 dead' END || ' at ' || strftime(ts, '%Y-%m-%d %H:%M') || ' in ' || props AS message FROM events),
                named AS (SELECT event_type, regexp_replace(message, 'req_[a-zA-Z0-9]+', '', 'g') AS message FROM m)
           SELECT event_type || ':' || left(regexp_replace(regexp_replace(message, '\b[0-9a-fA-F]{6,}\b', '', 'g'), '\d+', '#', 'g'), 160) AS signature, count(*) AS n FROM named GROUP BY 1""")
def error_signature(spark, sf):
    tail = F.when(F.col("event_id") % 3 == 0, "_def").when(F.col("event_id") % 3 == 1, " myreq_abc1").otherwise(" deadBEEF99 dead")
    message = F.concat(F.lit("failed req_"), F.col("user_id").cast("string"), tail, F.lit(" at "), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" in "), "props")
    return table(spark, sf, "events").groupBy(text.error_signature("event_type", message).alias("signature")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, concat_ws('; ', 'o_orderstatus: ' || o_orderstatus, 'note: ' || CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END, 'o_custkey: ' || o_custkey) AS line FROM orders")
def row_text(spark, sf):
    rows = table(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")))
    return rows.select("o_orderkey", text.row_text(["o_orderstatus", "note", "o_custkey"]).alias("line"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS clipped, substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 300) AS summary, ceil(length(text) / 4.0)::INT AS tokens FROM documents")
def clip_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clip("text", 60).alias("clipped"), text.collapse("text", 300).alias("summary"), text.token_estimate("text").alias("tokens"))


@query("""WITH b AS (SELECT page_id, string_split_regex(html, '(?i)<style') AS p FROM pages),
               s AS (SELECT page_id, string_split(p[1] || array_to_string(list_transform(p[2:], lambda x: CASE WHEN contains(lower(x), '</style>') THEN substr(x, strpos(lower(x), '</style>') + 8) ELSE '<style' || x END), ''), '>') AS p FROM b),
               t AS (SELECT page_id, array_to_string(list_transform(p[:len(p) - 1], lambda x: CASE WHEN strpos(x, '<') = 0 OR strpos(x, '<') = length(x) THEN x || '>'
                     ELSE substr(x, 1, strpos(x, '<') - 1) || CASE WHEN lower(substr(x, strpos(x, '<') + 1)) IN ('/p', '/div', 'br', 'br/', 'br /') THEN chr(10) ELSE '' END END), '') || p[len(p)] AS text FROM s),
               e AS (SELECT page_id, replace(replace(replace(replace(text, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS text FROM t)
          SELECT page_id, trim(regexp_replace(text, chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM e""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_text("html").alias("text"))


@query("SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)[1] AS first_item, list_sum(list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: length(x)))::BIGINT AS chars FROM pages")
def html_items(spark, sf):
    items = F.regexp_extract_all("html", F.lit("(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    total = F.when(F.size(items) > 0, F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + F.length(x)))
    return table(spark, sf, "pages").select("page_id", F.get(items, 0).alias("first_item"), total.alias("chars"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS value FROM orders")
def parse_number(spark, sf):
    shown = F.format_number("o_totalprice", 2)
    cell = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("about "), shown)).when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), shown, F.lit(")"))).otherwise(F.concat(F.lit("$"), shown))
    return table(spark, sf, "orders").select("o_orderkey", numbers.to_number(cell).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def parse_date(spark, sf):
    key = F.col("o_custkey") % 5
    cell = F.when(key == 0, F.date_format("o_orderdate", "13/dd/yyyy")).when(key < 3, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", dates.to_iso_date(cell).alias("day"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate AS d, year(o_orderdate) >= 2000 AS named FROM orders)
          SELECT o_orderkey, CASE WHEN named THEN date_trunc('month', d)::DATE ELSE DATE '2026-09-29' END AS first, CASE WHEN named THEN last_day(d) ELSE DATE '2026-09-29' END AS last, CASE WHEN named THEN 'month' END AS grain,
                 CASE WHEN named THEN ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(d)::INT] || ' ' || year(d) ELSE '' END AS label FROM t""")
def period_from_names(spark, sf):
    """Folders before 2000 name no year that is read; their files have the day on which they changed."""
    rows = table(spark, sf, "orders")
    folders = F.array(F.lit("Sales"), F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM - MMMM"))
    rows = rows.withColumn("p", dates.parse_period(folders, F.lit("summary.xlsx"), F.lit("2026-09-29")))
    return rows.select("o_orderkey", F.col("p.start").alias("first"), F.col("p.end").alias("last"), F.col("p.grain").alias("grain"), dates.period_label("p.start", "p.end", "p.grain").alias("label"))


@query("""SELECT word, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(word, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619::BIGINT) & 4294967295::BIGINT)) AS hash
          FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark)""")
def fnv_token_hash(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("word")).distinct()
    return words.select("word", vectors.fnv1a("word").alias("hash"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
               c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2),
               d AS (SELECT word, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(word, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619::BIGINT) & 4294967295::BIGINT) % 384)::INT AS bucket FROM (SELECT DISTINCT word FROM c)),
               b AS (SELECT doc_id, bucket, sum(n) AS n FROM c JOIN d USING (word) GROUP BY 1, 2)
          SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""")
def hash_embedding_sparse(spark, sf):
    out = vectors.hash_embedding(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query(f"""WITH k AS (SELECT item_id, list_distinct({WORDS}) AS words FROM benchmark)
           SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)), 6) AS overlap FROM k a JOIN k b ON a.item_id < b.item_id
           WHERE len(a.words) > 0 AND len(b.words) > 0 AND len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) >= 0.2""")
def overlap_coefficient_pairs(spark, sf):
    rows = table(spark, sf, "benchmark").withColumn("words", text.keywords("text"))
    return similar_pairs(rows, "item_id", "words", 0.2).withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH n AS (SELECT item_id, list_distinct({WORDS}) AS words FROM benchmark), o AS (SELECT conv_id * 1000 + turn AS match, list_distinct({WORDS}) AS words FROM conversations),
           p AS (SELECT item_id, match, len(list_intersect(n.words, o.words)) / least(len(n.words), len(o.words)) AS overlap FROM n JOIN o ON len(n.words) > 0 AND len(o.words) > 0)
           SELECT item_id, match, round(overlap, 6) AS overlap FROM p WHERE overlap >= 0.1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, match) = 1""")
def near_duplicate_rule(spark, sf):
    new = table(spark, sf, "benchmark").select("item_id", text.keywords("text").alias("words"))
    old = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), text.keywords("text").alias("words"))
    return best_match(new, old, "item_id", "words", 0.1).withColumn("overlap", F.round("overlap", 6))


@query("""WITH c AS (SELECT item_id, split_part(text, ' ', 2) AS needle FROM benchmark)
          SELECT item_id, min(doc_id) AS first_doc FROM c JOIN documents ON contains(documents.text, c.needle) GROUP BY 1""")
def contains_theta_join(spark, sf):
    """Needles meet texts on the rarest of their character runs."""
    needles = table(spark, sf, "benchmark").select("item_id", F.split_part("text", F.lit(" "), F.lit(2)).alias("needle"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return contained(needles, texts).join(needles, "needle").groupBy("item_id").agg(F.min("text_id").alias("first_doc"))


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN upper(c_mktsegment) ELSE (['tin', 'BRASS', 'o', 'Economy', 'ed ni'])[c_custkey % 5 + 1] END AS dataset FROM customer),
               f AS (SELECT p_partkey AS place, p_type || ' ' || p_partkey || '.xlsx' AS file, CASE WHEN p_partkey % 50 = 0 THEN 'Machinery' WHEN p_partkey % 3 > 0 THEN p_brand END AS dataset FROM part)
          SELECT id, arg_min(file, place) AS contradicts FROM c LEFT JOIN f ON lower(c.dataset) = lower(f.dataset) OR contains(lower(file), lower(c.dataset)) GROUP BY id""")
def corrections_contradicted(spark, sf):
    """The first cited file of a correction's dataset, or whose name holds it."""
    listed = F.element_at(F.array(*[F.lit(x) for x in ("tin", "BRASS", "o", "Economy", "ed ni")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    nine = F.col("c_custkey") % 9
    corrections = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(nine == 1, F.upper("c_mktsegment")).when(nine > 1, listed).alias("dataset"))
    file = F.concat("p_type", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".xlsx"))
    dataset = F.when(F.col("p_partkey") % 50 == 0, "Machinery").when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))
    cited = table(spark, sf, "part").select(F.col("p_partkey").alias("position"), file.alias("file"), dataset.alias("dataset"))
    return state.contradicted(corrections, cited).select("id", "contradicts")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS words FROM documents),
                g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) AS grams FROM w WHERE len(words) >= 5),
                c AS (SELECT min(doc_id) AS class, count(*) AS members, grams FROM g GROUP BY grams),
                e AS (SELECT class, len(grams) AS n, unnest(grams) AS gram FROM c),
                p AS (SELECT a.class AS a, b.class AS b, count(*) / least(a.n, b.n) AS overlap FROM e a JOIN e b ON a.gram = b.gram AND a.class < b.class GROUP BY a.class, b.class, a.n, b.n)
           SELECT p.a, p.b, round(overlap, 6) AS overlap, x.members AS members_a, y.members AS members_b FROM p JOIN c x ON x.class = p.a JOIN c y ON y.class = p.b WHERE overlap >= 0.8""")
def texts_mostly_within_others(spark, sf):
    """Texts whose five-word runs lie for four fifths in another text, by classes of texts with equal runs."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    run = lambda w: lambda i: F.xxhash64(F.array_join(F.slice(w, i, 5), " "))
    runs = text.bound(words, lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), run(w))))
    rows = table(spark, sf, "documents").select("doc_id", runs.alias("runs"))
    pairs, members = similar_classes(rows, "doc_id", "runs", 0.8)
    sizes = members.groupBy("class").agg(F.count("*").alias("members"))
    return pairs.join(sizes.toDF("a", "members_a"), "a").join(sizes.toDF("b", "members_b"), "b").select("a", "b", F.round("overlap", 6).alias("overlap"), "members_a", "members_b")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(pay( now)?|purchase|buy now|place (your )?order|checkout|check out|transfer( funds)?|confirm payment|submit payment|approve payment)\\b') THEN 'Pay' WHEN regexp_matches(lower(text), '\\b(delete|remove|trash|discard|erase|permanently)\\b') THEN 'Delete' WHEN regexp_matches(lower(text), '\\b(send|post|publish|reply( all)?|forward|share|invite)\\b') THEN 'Send' END AS risk FROM conversations".replace("\\\\", "\\"))
def label_risk(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.click_risk("text").alias("risk"))


@query("SELECT o_custkey, list_sort(list_distinct(flatten(list(months)))) AS months FROM (SELECT o_custkey, [strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m')] AS months FROM orders) GROUP BY 1")
def months_union(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.array(F.date_format("o_orderdate", "yyyy-MM"), F.date_format(F.expr("o_orderdate + interval 40 days"), "yyyy-MM")).alias("months"))
    return rows.groupBy("o_custkey").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("months")))).alias("months"))


@query("SELECT user_id, round(0.5 + 0.5 / (1 + greatest(0, (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(max(ts))) / 86400000000.0 - 7) / 90), 9) AS recency FROM events GROUP BY 1")
def recency_weight(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("created"))
    return last.select("user_id", F.round(dates.recency("created", F.lit("2024-06-01").cast("timestamp")), 9).alias("recency"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS words FROM documents),
               t AS (SELECT doc_id, words, array_to_string(words, ' ') AS whole FROM d),
               long AS (SELECT doc_id, words FROM t WHERE 2 * ceil(length(whole) / 4.0) > 600),
               items AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM long),
               sums AS (SELECT doc_id, i, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto FROM items UNION ALL SELECT doc_id, 0, 0 FROM long),
               runs AS MATERIALIZED (SELECT doc_id, i AS a, greatest(i + 1, count(*) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN UNBOUNDED PRECEDING AND 801 FOLLOWING) - 1) AS b, max(i) OVER (PARTITION BY doc_id) AS n FROM sums),
               w AS (SELECT doc_id, 0 AS k, a, b, n FROM runs WHERE a = 0
                     UNION ALL SELECT w.doc_id, w.k + 1, r.a, r.b, r.n FROM w JOIN runs r ON r.doc_id = w.doc_id AND r.a = greatest(w.a + 1, w.b - greatest(1, floor((w.b - w.a) * 0.15::DOUBLE + 0.5::DOUBLE)::BIGINT)) WHERE w.b < w.n),
               cut AS (SELECT doc_id, 0 AS k, whole AS text FROM t WHERE 2 * ceil(length(whole) / 4.0) <= 600
                       UNION ALL SELECT doc_id, k, array_to_string(words[a + 1:b], ' ') FROM w JOIN long USING (doc_id))
          SELECT doc_id, k::INT AS "window", text, ceil(length(text) / 4.0)::INT AS tokens FROM cut""")
def token_windows(spark, sf):
    """Windows of words; the SQL follows them from one to the next."""
    return windows_of(table(spark, sf, "documents"), "doc_id", "text")


@query(r"""WITH RECURSIVE split AS (SELECT conv_id, turn, role AS heading, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM (SELECT conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\n{2,}') AS parts FROM conversations)),
               paras AS MATERIALIZED (SELECT conv_id, heading, trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i FROM split WHERE trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
               packed AS (SELECT conv_id, i, 0 AS parent, length(text) AS held, heading AS begun FROM paras WHERE i = 0
                          UNION ALL SELECT conv_id, i, parent + closes::INT, CASE WHEN closes THEN n ELSE held + 2 + n END, CASE WHEN closes THEN heading ELSE begun END FROM
                          (SELECT q.conv_id, q.i, p.parent, p.held, p.begun, q.heading, length(q.text) AS n, ceil(p.held / 4.0) + ceil(length(q.text) / 4.0) > 1000 OR (q.heading IS DISTINCT FROM p.begun AND ceil(p.held / 4.0) >= 300) AS closes
                           FROM packed p JOIN paras q ON q.conv_id = p.conv_id AND q.i = p.i + 1)),
               parents AS (SELECT conv_id, parent, arg_min(heading, i) AS heading, string_agg(text, chr(10) || chr(10) ORDER BY i) AS parent_text FROM packed JOIN paras USING (conv_id, i) GROUP BY ALL),
               t AS (SELECT conv_id, i, words, array_to_string(words, ' ') AS whole FROM (SELECT conv_id, i, regexp_extract_all(text, '\S+') AS words FROM paras)),
               long AS (SELECT conv_id, i, words FROM t WHERE 2 * ceil(length(whole) / 4.0) > 600),
               items AS (SELECT conv_id, i, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM long),
               sums AS (SELECT conv_id, i, j, sum(length(word) + 1) OVER (PARTITION BY conv_id, i ORDER BY j)::BIGINT AS upto FROM items UNION ALL SELECT conv_id, i, 0, 0 FROM long),
               runs AS MATERIALIZED (SELECT conv_id, i, j AS a, greatest(j + 1, count(*) OVER (PARTITION BY conv_id, i ORDER BY upto RANGE BETWEEN UNBOUNDED PRECEDING AND 801 FOLLOWING) - 1) AS b, max(j) OVER (PARTITION BY conv_id, i) AS n FROM sums),
               w AS (SELECT conv_id, i, 0 AS k, a, b, n FROM runs WHERE a = 0
                     UNION ALL SELECT w.conv_id, w.i, w.k + 1, r.a, r.b, r.n FROM w JOIN runs r ON r.conv_id = w.conv_id AND r.i = w.i AND r.a = greatest(w.a + 1, w.b - greatest(1, floor((w.b - w.a) * 0.15::DOUBLE + 0.5::DOUBLE)::BIGINT)) WHERE w.b < w.n),
               cut AS (SELECT conv_id, i, 0 AS k, whole AS text FROM t WHERE 2 * ceil(length(whole) / 4.0) <= 600
                       UNION ALL SELECT conv_id, i, k, array_to_string(words[a + 1:b], ' ') FROM w JOIN long USING (conv_id, i))
          SELECT conv_id, parent::INT AS parent, heading, NULL::INT AS page_from, NULL::INT AS page_to, (row_number() OVER (PARTITION BY conv_id, parent ORDER BY i, k) - 1)::INT AS child, NULL::INT AS page,
                 cut.text AS text, ceil(length(cut.text) / 4.0)::INT AS tokens, parent_text FROM cut JOIN packed USING (conv_id, i) JOIN parents USING (conv_id, parent)""")
def parent_packing(spark, sf):
    """Turns of conversations packed into parents and cut into children; the SQL follows the packing from turn to turn."""
    sections = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("heading"), F.lit(None).cast("int").alias("page"), "text")
    return chunk_documents(sections, "conv_id")
