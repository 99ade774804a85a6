"""Streams over the events table, run to its end, and their batch forms."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.buckets import BucketStore, Table
from tessera.queries.base import query, table
from tessera.sources import feed
from tessera.sources.shared import names, publish_text, shared_path
from tessera.streaming import cdc

WAIT_S = 600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    """A table's files as a stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{sf}/{name}.parquet*")


def finished(rows: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """The rows that a stream has given when its input is used up."""
    path = shared_path(spark, name)
    if mode == "append":
        running = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    else:
        # Each batch of a complete result replaces the one before.
        running = rows.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    if not running.awaitTermination(WAIT_S):
        running.stop()
        raise TimeoutError(f"the stream {name} did not end")
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, sf):
    counts = cdc.window_counts(stream(spark, sf), "ts", "1 day", "event_type")
    out = finished(counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n"), spark, "windows", "complete")
    return out


@query("""WITH h AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events)
          SELECT strftime(w, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM h GROUP BY ALL""")
def sliding_window_counts(spark, sf):
    counts = cdc.window_counts(table(spark, sf, "events"), "ts", "2 hours", "event_type", slide="1 hour")
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


# A change feed of the events: a page a day, an error is a tombstone of its user.

ITEMS = "id long, event_id long, ts timestamp_ntz, value double, deleted boolean"
#: Rows of a piece of a page.
PIECE = 1 << 16
DAY = "datediff(ts, DATE '2024-01-01')"
ROWS = "id long, event_id long, value double, epoch int"
ORDER = ("ts", "event_id")


def staged_pages(spark: SparkSession, sf: str, root: str) -> list[str]:
    """Writes the pages of the feed beside it and names them in order."""
    items = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "ts", "value", (F.col("event_type") == "error").alias("deleted"), F.expr(DAY).alias("page"))
    items.repartition("page").write.option("maxRecordsPerFile", PIECE).partitionBy("page").parquet(f"{root}/staged")
    return sorted((n for n in names(spark, f"{root}/staged") if n.startswith("page=")), key=lambda n: int(n[5:]))


def published(spark: SparkSession, root: str, pages: list[str]) -> None:
    """Moves staged pages into the feed."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/feed"))
    for page in pages:
        fs.rename(path(f"{root}/staged/{page}"), path(f"{root}/feed/{page}"))


def fed(spark: SparkSession, root: str, sink, pages_per_batch: int = 1) -> None:
    """Takes what the feed has, from where its checkpoint ends."""
    rows = feed.changes(spark, f"{root}/feed", ITEMS, pages_per_batch=pages_per_batch)
    cdc.caught_up(cdc.stream_table(rows, [sink], f"{root}/checkpoint", once=False))


def user_store(spark: SparkSession, root: str, **more: Table) -> BucketStore:
    return BucketStore(spark, f"{root}/store", {"users": Table(ROWS, ("id",))} | more)


@query("SELECT user_id AS id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'")
def stream_cdc_foreach_batch(spark, sf):
    """A micro-batch a day, applied to the buckets that it touches; the last commit read back."""
    root = shared_path(spark, "cdc")
    published(spark, root, staged_pages(spark, sf, root))
    store = user_store(spark, root)
    fed(spark, root, cdc.store_sink(store, {"users": cdc.kept_rows(store, "users", ORDER)}))
    return store.rows("users").select("id", "event_id", "value")


@query("""WITH e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) // 5 AS batch FROM events)
          SELECT batch, 'users' AS "table", count(DISTINCT ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 256) AS buckets FROM e GROUP BY batch""")
def stream_buckets_rewritten(spark, sf):
    """How many of a table's buckets each micro-batch of five pages has rewritten; the feed's end, which sweeps, is left out."""
    root = shared_path(spark, "buckets")
    published(spark, root, staged_pages(spark, sf, root))
    store = BucketStore(spark, f"{root}/store", {"users": Table(ROWS, ("id",), 256)})
    fed(spark, root, cdc.store_sink(store, {"users": cdc.kept_rows(store, "users", ORDER)}), 5)
    pages = -(-len(names(spark, f"{root}/feed")) // 5)
    return store.history().filter(F.col("batch") < pages).groupBy("batch", "table").agg(F.count("*").alias("buckets"))


@query("""WITH last AS (SELECT user_id AS id, event_id, value, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-21' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
          SELECT id, event_id, part, round(value * part, 4) AS share FROM last, generate_series(1, event_id % 3 + 1) p(part) WHERE event_type <> 'error'""")
def stream_feed_resync(spark, sf):
    """Users and their parts in one commit, through a batch that fails once, a restart, and a feed that forgets the cursor.

    The feed first has ten days; one batch fails after its commit, another
    before.  Then it forgets all but the last ten days, so that everything is
    read anew and what is not named any more is swept.
    """
    root = shared_path(spark, "resync")
    pages = staged_pages(spark, sf, root)
    store = user_store(spark, root, parts=Table("id long, event_id long, part long, share double, epoch int", ("id",)))
    part = F.explode(F.sequence(F.lit(1).cast("long"), F.col("event_id") % 3 + 1))

    def parts(rows: DataFrame) -> DataFrame:
        return rows.select("id", "event_id", "value", "epoch", part.alias("part")).withColumn("share", F.round(F.col("value") * F.col("part"), 4))

    apply = cdc.store_sink(store, {"users": cdc.kept_rows(store, "users", ORDER), "parts": cdc.kept_parts(store, "parts", ORDER, parts)})
    failed = []

    def sink(batch: DataFrame, number: int) -> None:
        if number == 2 and "before" not in failed:
            failed.append("before")
            raise OSError("the store is away")
        apply(batch, number)
        if number == 3 and "after" not in failed:
            failed.append("after")
            raise OSError("the answer of the store is lost")

    published(spark, root, [p for p in pages if int(p[5:]) < 10])
    while len(failed) < 3:
        try:
            fed(spark, root, sink, 2)
            break
        except StreamingQueryException:
            continue
    published(spark, root, [p for p in pages if int(p[5:]) >= 10])
    publish_text(spark, f"{root}/feed/oldest=20", "")
    fed(spark, root, sink, 3)
    return store.rows("parts").join(store.rows("users").select("id"), "id", "left_semi").select("id", "event_id", "part", "share")


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 3 MINUTE, TRUE)::INT AS new FROM events),
               s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
          SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_gap(spark, sf):
    out = cdc.sessions(table(spark, sf, "events"), "user_id", "ts")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT max(ts) + INTERVAL 3 MINUTE < TIMESTAMP '2024-02-15' AS idle FROM events")
def idle_check(spark, sf):
    return cdc.idle(table(spark, sf, "events"), "ts", F.lit("2024-02-15").cast("timestamp_ntz"))


CAP_SQL = """WITH RECURSIVE e AS (SELECT 's' || user_id % 7 AS source, event_id, 'user:' || user_id AS signature, epoch_us(ts)::DOUBLE / 1e6::DOUBLE AS moment FROM events WHERE event_type = 'error'),
               o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY moment, event_id) AS k FROM e),
               s AS (SELECT source, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS signature, NULL::DOUBLE AS moment, FALSE AS admitted, []::STRUCT(signature VARCHAR, moment DOUBLE)[] AS hour FROM (SELECT DISTINCT source FROM e)
                     UNION ALL SELECT source, k, event_id, signature, moment, fits, CASE WHEN fits THEN list_append(hour, {'signature': signature, 'moment': moment}) ELSE hour END
                     FROM (SELECT *, len(hour) < 4 AND len(list_filter(hour, lambda x: x.signature = signature AND moment - x.moment < 1800)) = 0 AS fits
                           FROM (SELECT o.source, o.k, o.event_id, o.signature, o.moment, list_filter(s.hour, lambda x: o.moment - x.moment < 3600) AS hour FROM s JOIN o ON o.source = s.source AND o.k = s.k + 1)))
          SELECT source, event_id, signature, moment AS "at" FROM s WHERE admitted"""


def capped_events(spark, sf) -> DataFrame:
    """Errors by source and signature, with their time as seconds and as a timestamp."""
    source, signature = F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")), F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return stream(spark, sf).filter("event_type = 'error'").select(source.alias("source"), "event_id", signature.alias("signature"), at.alias("at"), F.col("ts").cast("timestamp").alias("moment"))


@contextmanager
def rocks(spark):
    """State in RocksDB while a stream with state of its own runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@query(CAP_SQL)
def rate_cap_dedupe(spark, sf):
    """Errors admitted once in half an hour by signature, four an hour by source."""
    with rocks(spark):
        return finished(cdc.rate_capped(capped_events(spark, sf).drop("moment")), spark, "ratecap")


@query(f"SELECT count(*) AS admitted, 0::BIGINT AS state_rows FROM ({CAP_SQL})")
def rate_cap_forgets(spark, sf):
    """The same in event time: a day after the last error no source has any state left."""
    path = shared_path(spark, "forgets")
    # The heartbeat is a file of its own behind the events.
    last = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("last")).first()["last"]
    beat = F.lit(last) + F.expr("interval 1 day")
    rows = capped_events(spark, sf)
    beats = spark.createDataFrame([(None, -1, None, 0.0)], "source string, event_id long, signature string, at double").withColumn("moment", beat)
    beats.write.parquet(f"{path}/beats")
    both = rows.unionByName(spark.readStream.schema(beats.schema).parquet(f"{path}/beats"))
    with rocks(spark):
        running = cdc.rate_capped_in_time(both, "moment", until=beat).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").start()
        cdc.caught_up(running)
        left = cdc.remembered(spark, f"{path}/checkpoint").count()
    return spark.read.schema(cdc.CAPPED).parquet(f"{path}/out").agg(F.count("*").alias("admitted")).withColumn("state_rows", F.lit(left).cast("long"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT ts::DATE) AS told FROM events GROUP BY event_type""")
def stream_snapshot_and_deltas(spark, sf):
    """Counts in update mode over a page a day: the last row of each key, and how often it was told anew."""
    path = shared_path(spark, "deltas")
    table(spark, sf, "events").select("event_type", F.expr(DAY).alias("page")).repartition("page").write.partitionBy("page").parquet(f"{path}/pages")
    pages = spark.readStream.schema("event_type string").option("maxFilesPerTrigger", 1).parquet(f"{path}/pages/page=*")
    deltas = cdc.Deltas(spark, f"{path}/told", ("event_type",), "event_type string, n long")
    counts = pages.groupBy("event_type").agg(F.count("*").alias("n"))
    running = counts.writeStream.outputMode("update").foreachBatch(deltas.sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    if not running.awaitTermination(WAIT_S):
        running.stop()
        raise TimeoutError("the counts did not end")
    told = deltas.since().groupBy("event_type").agg(F.count("*").alias("told"))
    return deltas.snapshot().join(told, "event_type").select("event_type", "n", "told")
