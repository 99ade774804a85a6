"""Change data capture and stateful streams on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.buckets import BucketStore, Commit, Rewrite, newest
from tessera.operators.state import latest

#: One resync, so many changes, or this share of a large source goes slowly.
SLOW_CHANGES, SLOW_SHARE, SLOW_SOURCE = 200, 0.1, 100
SLOW_RATE, PAUSE_ABOVE_MS = 20, 1500.0


def apply_changes(current: DataFrame, changes: DataFrame, key: str, order: tuple[str, ...], deleted: str) -> DataFrame:
    """Current rows after changes: the last change of a key holds, a tombstone removes it."""
    last = latest(changes, (key,), order)
    kept = current.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter(~F.col(deleted)).select(*current.columns))


def skip_unchanged(changes: DataFrame, current: DataFrame, key: str = "id", tag: str = "ctag") -> DataFrame:
    """Changes whose version tag is not the one already there."""
    known = current.select(key, F.col(tag).alias("__tag"))
    return changes.join(known, key, "left").filter(~F.coalesce(F.col(tag) == F.col("__tag"), F.lit(False))).drop("__tag")


def sweep(documents: DataFrame, seen: DataFrame, key: str = "item_id") -> DataFrame:
    """After a full resync: documents that were seen, also those that could not be read this time."""
    return documents.join(seen.select(key).distinct(), key, "left_semi")


def slow_lane(resync: bool, changes: int, source_size: int) -> bool:
    return resync or changes > SLOW_CHANGES or (source_size >= SLOW_SOURCE and changes > SLOW_SHARE * source_size)


class Pacer:
    """Holds a slow lane back while queries are slow, and to a rate otherwise."""

    def __init__(self, p95: Callable[[], float], sleep: Callable[[float], None] = time.sleep, rate: int = SLOW_RATE) -> None:
        self.p95, self.sleep, self.gap = p95, sleep, 60.0 / rate

    def wait(self, spent: float = 0.0) -> None:
        while self.p95() > PAUSE_ABOVE_MS:
            self.sleep(5.0)
        if spent < self.gap:
            self.sleep(self.gap - spent)


def stream_table(changes: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch, kept once, goes to every sink; the cursor moves only after all of them.

    A batch that fails is delivered again, so sinks have to be idempotent, such
    as those that overwrite a path with the batch's number, or those of a
    BucketStore.  With `once` the stream ends with what is there now.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def caught_up(running: StreamingQuery) -> None:
    """Waits until a stream has taken what its source has, and stops it; an error of the stream is raised."""
    try:
        running.processAllAvailable()
    finally:
        running.stop()


#: What a micro-batch's changes make of one table.
Change = Callable[[DataFrame, int | None], Rewrite]


def store_sink(store: BucketStore, tables: dict[str, Change], writer: str = "", done: Callable[[Commit], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Applies the pages of a feed (see sources.feed) to all tables in one commit.

    Where the feed says that an epoch is whole, what none of its pages named
    is swept in the same commit.
    """

    def sink(batch: DataFrame, number: int) -> None:
        whole = batch.filter("kind = 'end'").agg(F.max("epoch")).first()[0]
        pages = batch.filter("kind = 'page'")
        commit = store.commit({name: change(pages, whole) for name, change in tables.items()}, number, writer)
        if done:
            done(commit)

    return sink


def kept_rows(store: BucketStore, table: str, order: tuple[str, ...], deleted: str = "deleted", epoch: str = "epoch") -> Change:
    """One row a key: its last change, or none where that is a tombstone."""
    key = list(store.tables[table].key)

    def change(pages: DataFrame, whole: int | None) -> Rewrite:
        def make(current: DataFrame) -> DataFrame:
            # Of a key's rows any change comes after what is there; all are added up in one pass.
            changes = pages.select(*dict.fromkeys([*current.columns, *order, deleted])).withColumn("__new", F.lit(True))
            there = current.withColumn(deleted, F.lit(False)).withColumn("__new", F.lit(False))
            last = newest(there.unionByName(changes, allowMissingColumns=True), tuple(key), ("__new", *order))
            rows = last.filter(~F.col(deleted)).select(*current.columns)
            return rows if whole is None else rows.filter(F.col(epoch) >= whole)

        return _touching(store, table, key, pages, whole), make

    return change


def kept_parts(store: BucketStore, table: str, order: tuple[str, ...], parts: Callable[[DataFrame], DataFrame], deleted: str = "deleted", epoch: str = "epoch") -> Change:
    """Rows that belong to a changed key, such as the chunks of a document: those of its last change in place of the earlier ones."""
    key = list(store.tables[table].key)

    def change(pages: DataFrame, whole: int | None) -> Rewrite:
        last = newest(pages, tuple(key), order)

        def make(current: DataFrame) -> DataFrame:
            rows = current.join(pages.select(*key).distinct(), key, "left_anti").unionByName(parts(last.filter(~F.col(deleted))).select(*current.columns))
            return rows if whole is None else rows.filter(F.col(epoch) >= whole)

        return _touching(store, table, key, pages, whole), make

    return change


def _touching(store: BucketStore, table: str, key: list[str], pages: DataFrame, whole: int | None) -> DataFrame:
    """The keys whose buckets a batch rewrites: those changed, and for a sweep all."""
    return pages.select(*key) if whole is None else pages.select(*key).unionByName(store.rows(table).select(*key))


def versioned_sink(spark: SparkSession, root: str, key: str, order: tuple[str, ...], deleted: str) -> Callable[[DataFrame, int], None]:
    """Writes the state after batch n below root/v<n> from that after n - 1: delivered again, a batch gives the same."""

    def sink(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c != deleted]
        current = spark.read.parquet(f"{root}/v{number - 1}") if number else batch.limit(0).select(*columns)
        apply_changes(current, batch, key, order, deleted).write.mode("overwrite").parquet(f"{root}/v{number}")

    return sink


def window_counts(events: DataFrame, time_column: str, width: str, *keys: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts in event-time windows; rows later than `late` may be left out of a stream."""
    stamped = events.withColumn(time_column, F.col(time_column).cast("timestamp"))
    stamped = stamped.withWatermark(time_column, late) if events.isStreaming else stamped
    return stamped.groupBy(F.window(time_column, width, slide), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, time_column: str, gap: str = "3 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with no gap as long as `gap` between them."""
    stamped = events.withColumn(time_column, F.col(time_column).cast("timestamp"))
    stamped = stamped.withWatermark(time_column, late) if events.isStreaming else stamped
    grouped = stamped.groupBy(key, F.session_window(time_column, gap)).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def idle(events: DataFrame, at: str, now, running: str | None = None, after: str = "3 minutes") -> DataFrame:
    """idle: whether the last event is longer ago than `after` and nothing runs."""
    quiet = F.max(at) + F.expr(f"interval {after}") < now
    return events.agg((quiet & ~F.coalesce(F.bool_or(running), F.lit(False)) if running else quiet).alias("idle"))


SUPPRESS_S, HOUR_S, PER_HOUR = 30 * 60.0, 3600.0, 4


class RateCap(StatefulProcessor):
    """Admits an event of a signature once in SUPPRESS_S, and PER_HOUR of a source in any hour."""

    def __init__(self, suppress: float = SUPPRESS_S, per_hour: int = PER_HOUR) -> None:
        self.suppress, self.per_hour = suppress, per_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "signature string", "at double")
        self.started = handle.getValueState("started", "at array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        times = list(self.started.get()[0]) if self.started.exists() else []
        out = []
        for e in events.itertuples():
            known = self.seen.getValue((e.signature,))
            if known is not None and e.at - known[0] < self.suppress:
                continue
            times = [t for t in times if e.at - t < HOUR_S]
            if len(times) >= self.per_hour:
                continue
            self.seen.updateValue((e.signature,), (e.at,))
            times.append(e.at)
            out.append((key[0], e.event_id, e.signature, e.at))
        if len(events):
            newest = events["at"].iloc[-1]
            for (signature,), (at,) in list(self.seen.iterator()):
                if newest - at > self.suppress:
                    self.seen.removeKey((signature,))
            self.started.update((times,))
        yield pd.DataFrame(out, columns=["source", "event_id", "signature", "at"])

    def close(self) -> None:
        pass


class ForgettingCap(RateCap):
    """The same in event time; a source without an event for an hour leaves no state behind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(rows)
        newest = max((float(r["at"].max()) for r in held if len(r)), default=0.0)
        yield from super().handleInputRows(key, iter(held), timerValues)
        due = int(1000 * (newest + HOUR_S))
        for known in list(self.handle.listTimers()):
            due = max(due, known)
            self.handle.deleteTimer(known)
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.started.clear()
        return iter([])


CAPPED = "source string, event_id long, signature string, at double"


def rate_capped(events: DataFrame) -> DataFrame:
    """Admitted events of (source, event_id, signature, at seconds), batch or stream."""
    return events.groupBy("source").transformWithStateInPandas(RateCap(), CAPPED, "append", "none")


def rate_capped_in_time(events: DataFrame, moment: str, late: str = "10 minutes", until: Column | None = None) -> DataFrame:
    """The same for a stream with event times in `moment`, where sources are forgotten an hour after their last event.

    `at` are the seconds of `moment`.  Events later than `late` are left out.  Those from `until` on move the time
    only: heartbeats of a quiet stream.
    """
    timed = events.withWatermark(moment, late)
    timed = timed if until is None else timed.filter(F.col(moment) < until)
    return timed.groupBy("source").transformWithStateInPandas(ForgettingCap(), CAPPED, "append", "eventTime")


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """source: whom a stream of ForgettingCap still remembers, read from the state behind its checkpoint."""
    return spark.read.format("statestore").option("stateVarName", "started").load(checkpoint).select("key.source")


class Deltas:
    """What a stream in update mode has told so far: a folder for each batch that changed anything, by key."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], schema: str) -> None:
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def sink(self, batch: DataFrame, number: int) -> None:
        """Delivered again, a batch overwrites its own folder."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def since(self, number: int = -1) -> DataFrame:
        """The rows told after a batch, with the batch they were told in."""
        told = self.spark.read.schema(f"{self.schema}, batch int").option("basePath", self.path).parquet(f"{self.path}/batch=*")
        return told.filter(F.col("batch") > number)

    def snapshot(self, number: int | None = None) -> DataFrame:
        """The last row of each key, up to a batch: what a reader begins with, before the deltas."""
        told = self.since() if number is None else self.since().filter(F.col("batch") <= number)
        return newest(told, self.key, ("batch",)).drop("batch")


def latest_per_interval(events: DataFrame, key: str, time_column: str, interval: str = "300 milliseconds") -> DataFrame:
    """Throttled updates: of each key the newest event of each interval."""
    at = F.col(time_column).cast("timestamp")
    return events.groupBy(F.window(at, interval), key).agg(F.max_by(F.struct(*events.columns), at).alias("last")).select("last.*")


def recent(events: DataFrame, time_column: str, tie: str, most: int = 40) -> DataFrame:
    """The last `most` events, newest first."""
    return events.orderBy(F.col(time_column).desc(), F.col(tie).desc()).limit(most)


def single_flight(spark: SparkSession, name: str, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """The running query of a name, or a new one: callers share it."""
    return next((q for q in spark.streams.active if q.name == name), None) or start()
